"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from functools import wraps

from pyspark.sql import functions as F

from plumbline.llm import (
    conversations,
    decontaminate,
    embeddings,
    lexical,
    line_dedup,
    packing,
    paragraphs,
    passages,
    personal,
    pseudo_likelihood,
    quality,
    simhash,
    token_output,
    warc,
)
from plumbline.plans.session import ship_package

QUERIES = {}
ORACLES = {}


def _query(name, sql=None):
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_paragraph_minhash")
def op1_paragraph_minhash(spark, sf_dir):
    """Paragraphs of 50 words or more that have a like, and passages of as many words that stand elsewhere, with the
    place of the one that stays: by `paragraph` its first line, by `word` its first word."""
    docs = _table(spark, sf_dir, "documents")
    found = paragraphs.repeated_paragraphs(docs).unionByName(passages.repeated_passages(docs), allowMissingColumns=True)
    return found.withColumnsRenamed({"id": "doc_id", "kept_id": "kept_doc_id"})


@_query("op2_bit_plane_tokens")
def op2_bit_plane_tokens(spark, sf_dir):
    """Token files of all documents, written and read back."""
    return token_output.token_round_trip(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query("op3_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM m""")
def op3_warc(spark, sf_dir):
    """A record per page in gzip-member archives, written and read back."""
    return warc.warc_round_trip(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@_query("op4_spherical_kmeans", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""")
def op4_spherical_kmeans(spark, sf_dir):
    """Near-duplicate vectors of equal labels."""
    found = embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumnsRenamed({"id": "vec_id", "component": "component_id"})


@_query("op5_factorisation_machine")
def op5_factorisation_machine(spark, sf_dir):
    """Quality scores of all documents."""
    docs = _table(spark, sf_dir, "documents")
    fitted = quality.train(docs, _table(spark, sf_dir, "labels"), size_column="n_chars")
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), fitted, size_column="n_chars")
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         F.col("score_").alias("score"), (F.col("score_") >= quality.THRESHOLD).cast("int").alias("predicted"))


@_query("op6_covering_simhash")
def op6_covering_simhash(spark, sf_dir):
    """Fingerprints of all documents and the components of those within four bits."""
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents")).drop("text_hash")
    return found.withColumnsRenamed({"id": "doc_id", "component": "component_id"})


@_query("op7_winnowed_lines", f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM d WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos AS s, {line_dedup.LINES} AS size, string_agg(line, chr(10)) OVER run AS body
  FROM l WINDOW run AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {line_dedup.LINES - 1} FOLLOWING)
  QUALIFY pos + {line_dedup.LINES} <= n
  UNION ALL
  SELECT doc_id, pos, 1, line FROM l WHERE len(list_filter(string_split(line, ' '), lambda x: x <> '')) >= {line_dedup.WORDS}),
f AS (SELECT *, row_number() OVER (PARTITION BY size, body ORDER BY doc_id, s) AS place FROM w),
gone AS (SELECT DISTINCT doc_id, s + i AS pos FROM f, range({line_dedup.LINES}) r(i) WHERE place > 1 AND i < size),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text, count(*) AS left_
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) - coalesce(k.left_, 0) END AS lines_removed
FROM d LEFT JOIN kept k USING (doc_id)""")
def op7_winnowed_lines(spark, sf_dir):
    """All documents without later repeats of runs of lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@_query("op8_pseudo_likelihood")
def op8_pseudo_likelihood(spark, sf_dir):
    """Masked pseudo-log-likelihood of every document."""
    return pseudo_likelihood.log_likelihood(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@_query("op9_prefix_filter", f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
         array_to_string(list_slice(w, s + 1, s + least(len(w), 10)), ' ') AS body
  FROM (SELECT *, unnest(range(len(w) - least(len(w), 10) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (
  SELECT doc_id, s, size, array_to_string(list_slice(w, s + 1, s + size), ' ') AS body
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS s FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT r.doc_id, r.s, r.size, win.item FROM runs r JOIN win ON r.size = win.size AND r.body = win.body),
cover AS (SELECT doc_id, count(DISTINCT s + i) AS n_hit FROM hits, range(10) t(i) WHERE i < size GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op9_prefix_filter(spark, sf_dir):
    """Benchmark windows in all documents."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").withColumnRenamed("id", "doc_id")


@_query("op10_best_fit")
def op10_best_fit(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query("op11_semi_markov")
def op11_semi_markov(spark, sf_dir):
    """Personal data in all documents: spans of the patterns, and those that the field adds."""
    return personal.digests(personal.find(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def _step(state, cost, letter):
    """SQL: a lattice state (cost in nine digits, then the audit) after an edit; null stays null."""
    return f"(printf('%09d', CAST(substr({state}, 1, 9) AS INTEGER) + ({cost})) || substr({state}, 10) || '{letter}')"


def _lattice(q0, qs, qu, qa):
    """SQL: the four states after any inserts; more than two in a row only come back to where they began."""
    for _ in range(2):
        to_user = [_step(q, 3, "I") for q in (q0, qs, qa)]
        q0, qs, qu, qa = "q0", "qs", f"least(qu, {', '.join(to_user)})", f"least(qa, {_step(qu, 3, 'I')})"
        yield f"SELECT * REPLACE ({qu} AS qu, {qa} AS qa)"
        q0, qs, qu, qa = "q0", "qs", "qu", "qa"


_CLOSE = list(_lattice("q0", "qs", "qu", "qa"))
_KEEP = "CASE WHEN NOT gone THEN extra END"
_REROLE = "CASE WHEN NOT gone THEN 3 + extra END"
_MOVE = f"""
  SELECT l.conv, l.n, l.i + 1 AS i, {_step('q0', 4, 'D')} AS q0,
    least({_step('qs', 4, 'D')}, CASE WHEN ini = 's' THEN {_step('q0', _KEEP, 'K')} END) AS qs,
    least({_step('qu', 4, 'D')}, CASE WHEN ini = 'u' THEN least({_step('q0', _KEEP, 'K')}, {_step('qs', _KEEP, 'K')}, {_step('qa', _KEEP, 'K')}) END,
          {_step('q0', _REROLE, 'R')}, {_step('qs', _REROLE, 'R')}, {_step('qa', _REROLE, 'R')}) AS qu,
    least({_step('qa', 4, 'D')}, CASE WHEN ini = 'a' THEN {_step('qu', _KEEP, 'K')} END, {_step('qu', _REROLE, 'R')}) AS qa
  FROM lat l JOIN r ON l.conv IS NOT DISTINCT FROM r.conv AND l.i + 1 = r.pos WHERE l.i < l.n"""
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@_query("op12_bidirectional_dijkstra", f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS tab FROM range(256) t(i)),
src AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hit AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
                                lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM src, crc),
d AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(2) c(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
o AS (
  SELECT *, pos > min(pos) OVER (PARTITION BY conv, role, text) AS again,
         rtrim(text, {_SPACES}) AS body, substr(role, 1, 1) AS ini FROM p),
r AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
         body = '' OR again AS gone, CASE WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra,
         lag(ini) OVER (PARTITION BY conv ORDER BY pos) || ini AS pair FROM o),
per AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
lat AS (
  {_CLOSE[1]} FROM ({_CLOSE[0]} FROM (
    SELECT conv, n, CAST(0 AS BIGINT) AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS qs, CAST(NULL AS VARCHAR) AS qu,
           CAST(NULL AS VARCHAR) AS qa FROM per))
  UNION ALL
  {_CLOSE[1]} FROM ({_CLOSE[0]} FROM ({_MOVE}))),
fin AS (SELECT conv, least(q0, qa) AS best FROM lat WHERE i = n),
fix AS (
  SELECT conv, substr(best, 10) AS audit, CAST(1 AS BIGINT) AS j, CAST(1 AS BIGINT) AS i, '' AS state, CAST(NULL AS VARCHAR) AS body FROM fin
  UNION ALL
  SELECT f.conv, f.audit, j + 1, i + CASE e WHEN 'I' THEN 0 ELSE 1 END,
         CASE e WHEN 'D' THEN state WHEN 'K' THEN ini ELSE CASE state WHEN 'u' THEN 'a' ELSE 'u' END END,
         CASE e WHEN 'D' THEN f.body ELSE coalesce(f.body || chr(10), '') || CASE e WHEN 'K' THEN role
           ELSE CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END END
  FROM (SELECT *, substr(audit, j, 1) AS e FROM fix WHERE j <= length(audit)) f
  LEFT JOIN (SELECT conv, pos, ini, role, text FROM r) t ON f.conv IS NOT DISTINCT FROM t.conv AND f.i = t.pos),
done AS (SELECT conv, body FROM fix WHERE j = length(audit) + 1),
ids AS (SELECT DISTINCT conv_id AS conv FROM conversations)
SELECT ids.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(best, 10), '') AS audit, sha256(coalesce(done.body, '')) AS repaired_sha256
FROM ids LEFT JOIN per ON ids.conv IS NOT DISTINCT FROM per.conv LEFT JOIN fin ON ids.conv IS NOT DISTINCT FROM fin.conv
LEFT JOIN done ON ids.conv IS NOT DISTINCT FROM done.conv""")
def op12_bidirectional_dijkstra(spark, sf_dir):
    """Repairs of all damaged conversations."""
    return conversations.repaired_digests(_table(spark, sf_dir, "conversations"))


@_query("op13_best_position", f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, row_number() OVER () AS r, w, CAST(len(w) AS HUGEINT) AS n FROM dw WHERE len(w) > 0),
t AS (SELECT count(*) AS n_docs, CAST(sum(n) AS HUGEINT) AS n_terms FROM d),
iw AS (SELECT DISTINCT item_id, text, list_distinct({_WORDS}) AS w FROM benchmark),
q AS (SELECT item_id, text, unnest(w) AS term FROM iw),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM p, t WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, text, doc_id, r,
             CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {lexical.BEST}""")
def op13_best_position(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    found = lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


@_query("pipeline")
def pipeline(spark, sf_dir):
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns find mail addresses, IP addresses, payment cards and telephone numbers.  The rest of a text that holds digits or
an at sign is cut into islands of tokens.  The field scores whole candidate segments: their numbers of digits, groups, dots and
separators, group sizes, checksum, shape as a domain, and both borders.  A dynamic program over segments of at most `LONGEST`
tokens chooses all boundaries and types of an island jointly.  It is trained here: on islands of the corpus that the patterns
label (at most `SAMPLE`, by smallest hash of distinct islands), on rewritten forms of them that the patterns miss (no plus
sign, bracketed signs, other separators), and on numbers that are no one's.  Spans that the patterns find stay as they are.
"""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import settle, slices

KINDS = ("email", "ip", "card", "phone")
#: Islands of the corpus that the field is fitted on, at most; and the longest that take part, in characters.
SAMPLE, SAMPLE_CHARS = 1200, 160
#: Tokens of the longest segment, and characters that an island reaches beyond a digit or sign.
LONGEST, REACH = 16, 64
EPOCHS, BATCH, RATE, DECAY = 5, 64, 0.08, 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a digit run is taken whole, so a match begins where a run begins; possessive runs keep long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]+")
_SIGN = r"[\[({](?:at|dot)[\])}]"
_TRIGGER = re.compile(rf"[0-9]+|@|{_SIGN}")
_TOKEN = re.compile(rf" ?{_SIGN} ?|[0-9]+|[A-Za-z]+|.", re.S)


def luhn(digits):
    """Whether a string of digits passes the Luhn checksum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _emails(text):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text):
    """Sorted (start, place of the kind, end) of the patterns, leftmost and non-overlapping for each kind."""
    out = [(a, 0, b) for _, a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(len(d) for d in _DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _edge(text, at, low):
    """Start of the run of non-space characters that ends at `at`, not before `low`."""
    return max(low, *(text.rfind(c, low, at) + 1 for c in " \n\t"))


def _run_end(text, at, high):
    ends = [e for e in (text.find(c, at, high) for c in " \n\t") if e >= 0]
    return min(ends, default=high)


def islands(text, spans):
    """(start, end, open) of the pieces of a text around digits and signs; open ones may hold more than `spans`."""
    out, last = [], -1
    for m in _TRIGGER.finditer(text):
        a, b = m.span()
        start = _edge(text, a, max(0, a - REACH))
        end = _run_end(text, b, min(len(text), b + REACH))
        if not "0" <= text[a] <= "9" and end - start == b - a:  # a sign of its own joins its neighbours
            start = _edge(text, max(0, start - 1), max(0, start - REACH))
            end = _run_end(text, min(len(text), end + 1), min(len(text), end + REACH))
        if out and start <= last + 2:
            last = max(last, end)
            out[-1][1] = last
        else:
            out.append([start, end])
            last = end
    held, i = [], 0
    for a, b in out:  # open: what is left without the known spans holds a sign or four digits
        while i < len(spans) and spans[i][2] <= a:
            i += 1
        rest, at, j = [], a, i
        while j < len(spans) and spans[j][0] < b:
            rest.append(text[at:max(at, spans[j][0])])
            at = max(at, spans[j][2])
            j += 1
        rest = " ".join([*rest, text[at:b]])
        more = "@" in rest or sum(len(d) for d in _DIGIT.findall(rest)) >= 4 or re.search(_SIGN, rest) is not None
        if more or at > a:
            held.append((a, b, more))
    return held


# Classes of tokens.
DIGIT, LETTER, DOT, MASKED_DOT, AT, MASKED_AT, SPACE, HYPHEN, PLUS, OPEN, CLOSE, JOINER, MARK, OTHER = range(14)
_CLASSES = {".": DOT, "@": AT, " ": SPACE, "-": HYPHEN, "+": PLUS, "(": OPEN, ")": CLOSE, "_": JOINER, "%": JOINER,
            **dict.fromkeys("/,:;'\"=", MARK)}
#: Sizes of the whole-span features, in the order in which `Pieces.features` makes them.
SIZES = (LONGEST + 1, 21, 8, 3, 6, 5, 3, 42, 42, 3, 3, 6, 9, 6, 36, 2, 5, 6)
_STARTS = np.concatenate(([0], np.cumsum(SIZES)))


def _class(token):
    c = token[0]
    if "0" <= c <= "9":
        return DIGIT
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return LETTER
    if len(token) > 1:
        return MASKED_AT if "at" in token else MASKED_DOT
    return _CLASSES.get(c, OTHER)


class Pieces:
    """Tokens of many islands in one row of arrays, their candidate segments, and the segments' features.

    `taken` lists spans per island that no segment may touch.
    """

    def __init__(self, texts, taken=None):
        tokens, owner, place = [], [], []
        self.first = [0]
        for i, text in enumerate(texts):
            at = 0
            for token in _TOKEN.findall(text):
                tokens.append(token)
                owner.append(i)
                place.append(at)
                at += len(token)
            self.first.append(len(tokens))
        self.tokens, self.owner = tokens, np.array(owner, np.int64)
        self.begin = np.array(place, np.int64)
        self.end = self.begin + np.array([len(t) for t in tokens], np.int64)
        self.first = np.array(self.first)
        self.cls = np.array([_class(t) for t in tokens], np.int64)
        blocked = np.zeros(len(tokens), bool)
        for i, spans in enumerate(taken or ()):
            own = slice(self.first[i], self.first[i + 1])
            for a, b in spans:
                blocked[own] |= (self.begin[own] < b) & (self.end[own] > a)
        self._candidates(blocked)

    def _sum(self, values):
        return np.concatenate(([0], np.cumsum(values)))

    def _candidates(self, blocked):
        n, cls = len(self.tokens), self.cls
        digits = np.where(cls == DIGIT, self.end - self.begin, 0)
        self.digits = self._sum(digits)
        self.signs = self._sum((cls == AT) | (cls == MASKED_AT))
        closed = self._sum(blocked)
        begins = np.isin(cls, (DIGIT, LETTER, PLUS, OPEN, DOT, JOINER)) & ~blocked
        ends = np.isin(cls, (DIGIT, LETTER))
        limit = self.first[self.owner + 1] if n else np.empty(0, np.int64)
        found = []
        for size in range(1, LONGEST + 1):
            a = np.flatnonzero(begins)
            a = a[a + size <= limit[a]]
            e = a + size
            ok = ends[e - 1] & (closed[e] == closed[a])
            ok &= (self.digits[e] - self.digits[a] >= 4) | (self.signs[e] > self.signs[a])
            found.append(np.stack([a[ok], e[ok]]))
        self.a, self.e = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)

    def features(self):
        """One place in the weights per candidate and feature."""
        a, e, cls = self.a, self.e, self.cls

        def held(mask):
            total = self._sum(mask)
            return total[e] - total[a]

        size = self.end - self.begin
        digit = cls == DIGIT
        n_digits, groups, signs = self.digits[e] - self.digits[a], held(digit), self.signs[e] - self.signs[a]
        dots, letters = held((cls == DOT) | (cls == MASKED_DOT)), held(cls == LETTER)
        n = len(cls)
        # a border: open (nothing or a space), a mark, or a mark or sign that goes on with letters or digits
        inner, top = np.isin(cls, (DIGIT, LETTER)), self.first[self.owner + 1] if n else cls
        low = self.first[self.owner] if n else cls
        here = np.arange(n)
        side = np.where(cls == SPACE, 0, np.where(inner, 2, 1))
        goes_on = (side == 1) & (here + 1 < top) & inner[np.minimum(here + 1, n - 1)]
        came_from = (side == 1) & (here > low) & inner[np.maximum(here - 1, 0)]
        before = np.where(a > self.first[self.owner[a]], np.where(came_from, 2, side)[np.maximum(a - 1, 0)], 0)
        after = np.where(e < self.first[self.owner[a] + 1], np.where(goes_on, 2, side)[np.minimum(e, n - 1)], 0)
        # the last two groups of digits and the first one, by the number of groups before a token
        at_groups = np.flatnonzero(digit)
        sizes = np.concatenate((np.minimum(size[at_groups], 5), [0]))
        count = self._sum(digit)
        last = np.where(groups > 0, sizes[count[e] - 1], 0)
        previous = np.where(groups > 1, sizes[np.maximum(count[e] - 2, 0)], 0)
        leading = np.where(groups > 0, sizes[np.minimum(count[a], len(sizes) - 1)], 0)
        wide = np.array([c == DIGIT and (s > 3 and t.lstrip("0")[3:] != "" or s <= 4300 and int(t[-4300:]) > 255)
                         for c, s, t in zip(cls.tolist(), size.tolist(), self.tokens)], bool)
        quad = (groups == 4) & (dots == 3) & (e - a == 7)
        ip = np.where(quad, np.where(held(wide) > 0, 1, 2), 0)
        check = np.zeros(len(a), np.int64)
        for k in np.flatnonzero((n_digits >= 12) & (n_digits <= 19) & (letters == 0) & (signs == 0)):
            joined = "".join(t for t, c in zip(self.tokens[a[k]:e[k]], cls[a[k]:e[k]]) if c == DIGIT)
            check[k] = 2 if luhn(joined) else 1
        sign_at = np.concatenate((np.flatnonzero((cls == AT) | (cls == MASKED_AT)), [n]))
        sign = sign_at[np.minimum(self.signs[a], len(sign_at) - 1)]
        all_dots = self._sum((cls == DOT) | (cls == MASKED_DOT))
        inside = np.minimum(sign, e - 1)
        domain = (signs == 1) & (cls[e - 1] == LETTER) & (size[e - 1] > 1) & (all_dots[e] > all_dots[inside]) & (inside > a)
        bins = (e - a, np.minimum(n_digits, 20), np.minimum(groups, 7), np.minimum(signs, 2), np.minimum(dots, 5), np.minimum(letters, 4),
                np.minimum(held(cls >= MARK), 2), 3 * cls[a] + before, 3 * cls[e - 1] + after, check, ip,
                2 * np.minimum(held(cls == PLUS), 2) + (cls[a] == PLUS), 3 * np.minimum(held(cls == OPEN), 2) + np.minimum(held(cls == CLOSE), 2),
                np.minimum(held(cls == SPACE), 5), 6 * last + previous, domain.astype(np.int64), np.minimum(held(cls == HYPHEN), 4), leading)
        return np.stack([b + s for b, s in zip(bins, _STARTS)], axis=1) if len(a) else np.empty((0, len(SIZES)), np.int64)


class Field:
    """Weights: (kinds, features) of segments, of tokens outside by class, and of neighbouring labels (0 is outside)."""

    def __init__(self):
        k = len(KINDS)
        self.parts = [np.zeros((k, int(_STARTS[-1]))), np.zeros(14), np.zeros((k + 1, k + 1))]

    def grids(self, pieces, features, rows):
        """Padded scores of the islands `rows`: segments (island, begin, size - 1, kind) and tokens outside."""
        segment, outside, _ = self.parts
        first, last = pieces.first[rows], pieces.first[rows + 1]
        width = int((last - first).max(initial=1))
        where = np.full(len(pieces.first), -1)
        where[rows] = np.arange(len(rows))
        mine = np.flatnonzero(where[pieces.owner[pieces.a]] >= 0) if len(pieces.a) else np.empty(0, np.int64)
        a, e = pieces.a[mine], pieces.e[mine]
        island = where[pieces.owner[a]] if len(a) else a
        spot = (island, a - pieces.first[rows[island]] if len(a) else a, e - a - 1)
        scores = np.full((len(rows), width + 1, LONGEST, len(KINDS)), -np.inf)
        scores[spot] = segment[:, features[mine]].sum(axis=2).T
        tokens = np.zeros((len(rows), width))
        classes = np.full((len(rows), width), -1)
        for i, (b, c) in enumerate(zip(first, last)):
            classes[i, :c - b] = pieces.cls[b:c]
        tokens = np.where(classes >= 0, outside[np.maximum(classes, 0)], 0.0)
        return scores, tokens, classes, last - first, mine, spot

    def best(self, scores, tokens, lengths):
        """Viterbi: per island the chosen (begin, size, kind) in order."""
        follow = self.parts[2]
        m, width = tokens.shape
        k = len(KINDS)
        top = np.full((m, width + 1, k + 1), -np.inf)
        top[:, 0, 0] = 0
        entry = np.full((m, width + 1, k + 1), -np.inf)
        came = np.zeros((m, width + 1, k + 1), np.int64)
        size = np.ones((m, width + 1, k + 1), np.int64)
        for t in range(width + 1):
            if t:
                top[:, t, 0] = entry[:, t - 1, 0] + tokens[:, t - 1]
                longest = min(t, LONGEST)
                back = np.arange(1, longest + 1)
                ways = entry[:, t - back, 1:] + scores[:, t - back, back - 1]
                size[:, t, 1:] = ways.argmax(axis=1) + 1
                top[:, t, 1:] = ways.max(axis=1)
            steps = top[:, t, :, None] + follow
            came[:, t] = steps.argmax(axis=1)
            entry[:, t] = steps.max(axis=1)
        out = []
        for i, n in enumerate(lengths):
            t, y, spans = int(n), int(top[i, n].argmax()), []
            while t > 0:
                s = int(size[i, t, y]) if y else 1
                if y:
                    spans.append((t - s, s, y - 1))
                t -= s
                y = int(came[i, t, y])
            out.append(spans[::-1])
        return out

    def gradient(self, pieces, features, gold, rows):
        """(log-likelihood, gradients) of the islands `rows`, whose segments are `gold` (island -> {(begin, end): kind})."""
        segment, outside, follow = self.parts
        scores, tokens, classes, lengths, mine, spot = self.grids(pieces, features, rows)
        m, width = tokens.shape
        k = len(KINDS)
        low = -1e30
        scores = np.maximum(scores, low)
        ahead = np.full((m, width + 1, k + 1), low)
        ahead[:, 0, 0] = 0
        entry = np.empty((m, width + 1, k + 1))
        for t in range(width + 1):
            if t:
                ahead[:, t, 0] = entry[:, t - 1, 0] + tokens[:, t - 1]
                back = np.arange(1, min(t, LONGEST) + 1)
                ahead[:, t, 1:] = np.logaddexp.reduce(entry[:, t - back, 1:] + scores[:, t - back, back - 1], axis=1)
            entry[:, t] = np.logaddexp.reduce(ahead[:, t, :, None] + follow, axis=1)
        at_end = np.arange(m)
        total = np.logaddexp.reduce(ahead[at_end, lengths], axis=1)
        rest = np.full((m, width + 1, k + 1), low)
        leave = np.full((m, width + 1, k + 1), low)
        for t in range(width, -1, -1):
            if t < width:
                leave[:, t, 0] = tokens[:, t] + rest[:, t + 1, 0]
                on = np.arange(1, min(width - t, LONGEST) + 1)
                leave[:, t, 1:] = np.logaddexp.reduce(scores[:, t, on - 1] + rest[:, t + on, 1:], axis=1)
                rest[:, t] = np.logaddexp.reduce(follow + leave[:, t, None, :], axis=2)
            rest[at_end[lengths == t], t] = 0
        z = total[:, None]
        island, begin, extra = spot
        chance = np.exp(entry[island, begin, 1:] + scores[spot] + rest[island, begin + extra + 1, 1:] - z[island])
        chance_out = np.exp(np.minimum(entry[:, :-1, 0] + tokens + rest[:, 1:, 0] - z, 0)) * (classes >= 0)
        moves = np.exp(np.minimum(ahead[:, :-1, :, None] + follow + leave[:, :-1, None, :] - z[..., None, None], 0))
        moves[classes < 0] = 0
        want, score = -chance, -total.sum()
        want_out, want_moves = -chance_out, -moves.sum(axis=(0, 1))
        index = {(i, b, s): n for n, (i, b, s) in enumerate(zip(island.tolist(), begin.tolist(), extra.tolist()))}
        for i, row in enumerate(rows.tolist()):
            t, y, marks = 0, 0, gold[row]
            while t < lengths[i]:
                end, kind = marks.get(t, (t + 1, -1))
                score += follow[y, kind + 1]
                want_moves[y, kind + 1] += 1
                y = kind + 1
                if y:
                    n = index[i, t, end - t - 1]
                    want[n, kind] += 1
                    score += scores[i, t, end - t - 1, kind]
                else:
                    want_out[i, t] += 1
                    score += tokens[i, t]
                t = end
        grad = np.zeros_like(segment)
        for f in range(features.shape[1]):
            for y in range(k):
                grad[y] += np.bincount(features[mine, f], want[:, y], segment.shape[1])
        grad_out = np.bincount(np.maximum(classes, 0).ravel(), (want_out * (classes >= 0)).ravel(), 14)
        return score, [grad, grad_out, want_moves]


def _gold(pieces, i, spans):
    """{first token: (end token, kind)} of an island's spans, or None if one does not fit the candidates."""
    a, b = pieces.first[i], pieces.first[i + 1]
    begins = {int(x): n for n, x in enumerate(pieces.begin[a:b])}
    ends = {int(x): n + 1 for n, x in enumerate(pieces.end[a:b])}
    known = {(int(x - a), int(y - a)) for x, y in zip(pieces.a, pieces.e) if a <= x < b}
    out = {}
    for start, kind, end in spans:
        place = begins.get(start), ends.get(end)
        if place not in known:
            return None
        out[place[0]] = (place[1], kind)
    return out


def _forms(kind, text, rng):
    """Forms of a known span that the patterns miss."""
    digits = re.sub("[^0-9]", "", text)
    if kind == 3 and len(digits) >= 10:
        area, a, b = digits[-10:-7], digits[-7:-4], digits[-4:]
        lead = digits[:-10]
        return [f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{area} {a} {b}",
                f"00{lead or 1} {area} {a} {b}", f"{lead or 1}-{area}-{a}-{b}"]
    if kind == 0:
        local, _, domain = text.partition("@")
        return [f"{local} (at) {domain}", f"{local} [at] " + domain.replace(".", " [dot] "), f"{local} @ {domain}",
                f"{local}[at]{domain}", f"{local}(at)" + domain.replace(".", "(dot)"), f"{local} {{at}} {domain}"]
    if kind == 1:
        return [text.replace(".", "[dot]"), text.replace(".", "(dot)"), text.replace(".", " [dot] ")]
    if kind == 2 and len(digits) == 16:
        four = [digits[i:i + 4] for i in range(0, 16, 4)]
        return [".".join(four), "  ".join(four), " - ".join(four)]
    return []


def _numbers(rng):
    """Numbers that name nobody."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    wrong = d(16)
    while luhn(wrong):
        wrong = d(16)
    return rng.choice([
        wrong, wrong, "-".join(wrong[i:i + 4] for i in (0, 4, 8, 12)), f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}", f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{d(2)}",
        f"{rng.randint(1, 30)}.{rng.randint(0, 20)}.{d(4)}", f"{d(3)},{d(3)}.{d(2)}", d(rng.randint(4, 11)), d(20), f"{d(4)}/{d(4)}",
        f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{d(3)}.{d(3)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(32))}"', f"{d(3)}-{d(5)}", f"pages {d(4)}-{d(4)}", f"{d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}.{d(3)}", f"{d(2)}-{d(3)}-{d(3)}-{d(4)}-{d(2)}",
        f"{rng.randint(1900, 2099)} {rng.randint(1900, 2099)}", f"name @ {d(2)}", "@someone", f"@user{d(4)}", f"{d(2)} (at) {d(3)}", f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}"])


def examples(sample, seed=11):
    """Labelled islands: those of the corpus by the patterns, rewritten ones, made ones.  (text, [(start, kind, end)])"""
    rng = random.Random(seed)
    out, known = [], [[] for _ in KINDS]
    for text in sample:
        spans = base_spans(text)
        if all(x[2] <= y[0] for x, y in zip(spans, spans[1:])):
            out.append((text, spans))
            for a, kind, b in spans:
                known[kind].append(text[a:b])
    made = [f"+{rng.randint(1, 99)} ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}" for _ in range(40)]
    names = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    mails = [f"{rng.choice(names)}{rng.choice(['.', '_', '-', ''])}{rng.choice([rng.choice(names), str(rng.randint(1, 99))])}@"
             f"{rng.choice(names)}{rng.choice(['', str(rng.randint(1, 9))])}.{rng.choice(['example.com', 'org', 'co.uk', 'net'])}" for _ in range(40)]
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(40)]
    cards = []
    while len(cards) < 40:
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        cards += [digits] if luhn(digits) else []
    for kind, own in enumerate((mails, ips, cards, made)):
        pool = own + sorted(set(known[kind]))[:80]
        for text in pool:
            forms = _forms(kind, text, rng)
            for form in ([text, *rng.sample(forms, min(2, len(forms)))]):
                left = rng.choice(["", "", "(", "tel:", "see ", f"{rng.choice(names)} "])
                right = rng.choice(["", "", ".", ",", ")", "$$$", " and"])
                spans = [s for s in base_spans(left + form + right)]
                span = (len(left), kind, len(left) + len(form))
                if not any(s != span and s[0] < span[2] and s[2] > span[0] for s in spans):
                    out.append((left + form + right, [span]))
    for _ in range(700):
        text = rng.choice(["", "", "no ", "(", "v"]) + _numbers(rng) + rng.choice(["", "", ".", ",", ")", "$$$"])
        if not base_spans(text):
            out.append((text, []))
    return out


def train(labelled, epochs=EPOCHS, batch=BATCH, rate=RATE, decay=DECAY, seed=5):
    """Fit a field to labelled islands by Adam steps on the log-likelihood."""
    pieces = Pieces([t for t, _ in labelled])
    features, field = pieces.features(), Field()
    gold = {i: _gold(pieces, i, spans) for i, (_, spans) in enumerate(labelled)}
    usable = np.array([i for i, g in gold.items() if g is not None and pieces.first[i + 1] > pieces.first[i]], np.int64)
    size = pieces.first[usable + 1] - pieces.first[usable]
    usable = usable[np.argsort(size, kind="stable")]  # a batch has islands of like length
    rng = np.random.default_rng(seed)
    mean = [np.zeros_like(p) for p in field.parts]
    square = [np.zeros_like(p) for p in field.parts]
    step = 0
    for _ in range(epochs):
        cuts = [usable[i:i + batch] for i in range(0, len(usable), batch)]
        for n in rng.permutation(len(cuts)):
            step += 1
            _, grads = field.gradient(pieces, features, gold, cuts[n])
            for j, g in enumerate(grads):
                g = g / len(cuts[n]) - decay * field.parts[j]
                mean[j] = 0.9 * mean[j] + 0.1 * g
                square[j] = 0.99 * square[j] + 0.01 * g * g
                field.parts[j] += rate * (mean[j] / (1 - 0.9 ** step)) / (np.sqrt(square[j] / (1 - 0.99 ** step)) + 1e-8)
    return field


#: Cells of a padded grid of scores that are worked on at once.
CELLS = 1 << 20


def added_spans(field, texts, taken):
    """Per island the (start, kind, end) that the field finds outside the spans taken."""
    out = [[] for _ in texts]
    if not texts:
        return out
    pieces = Pieces(texts, taken)
    if not len(pieces.a):
        return out
    features = pieces.features()
    rows = np.unique(pieces.owner[pieces.a])  # the others have no candidate
    size = pieces.first[rows + 1] - pieces.first[rows]
    rows, size = rows[np.argsort(size, kind="stable")], np.sort(size)
    at = 0
    while at < len(rows):
        to = at + 1
        while to < len(rows) and (to + 1 - at) * (size[to] + 1) * LONGEST * len(KINDS) <= CELLS:
            to += 1
        mine = rows[at:to]
        scores, tokens, _, lengths, _, _ = field.grids(pieces, features, mine)
        for row, spans in zip(mine.tolist(), field.best(scores, tokens, lengths)):
            b = pieces.first[row]
            out[row] = [(int(pieces.begin[b + t]), kind, int(pieces.end[b + t + n - 1])) for t, n, kind in spans]
        at = to
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_ISLAND = pa.struct([("start", pa.int64()), ("text", pa.string()), ("open", pa.bool_())])


def scan(docs, id_column="doc_id", text_column="text"):
    """(id, base, islands) of every row: spans of the patterns, and the pieces of text around digits and signs."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        for part in slices(batches):
            base, rest = [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                rest.append([{"start": a, "text": text[a:b], "open": more} for a, b, more in islands(text, spans)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(rest, pa.list_(_ISLAND))],
                                             ["id", "base", "islands"])

    return rows.mapInArrow(run, "id long, base array<struct<start:long,kind:int,end:long>>, islands array<struct<start:long,text:string,open:boolean>>")


def fit(scanned, sample=SAMPLE):
    """Fit the field on distinct islands of the corpus: half of them with spans of the patterns, half with an open rest."""
    pieces = scanned.select(F.explode("islands").alias("x")).select("x.text", "x.open").where(F.length("x.text") <= SAMPLE_CHARS)
    pieces = pieces.distinct()
    texts = []
    for side in ("open", "NOT open"):
        chosen = pieces.where(side).orderBy(F.xxhash64("text"), "text").limit(sample // 2)
        texts += [row["text"] for row in chosen.collect()]
    return train(examples(texts))


def find(docs, id_column="doc_id", text_column="text", sample=SAMPLE):
    """(id, base, spans) of every row: arrays of (start, kind, end) in characters, by start, kind as listed in KINDS, end.

    `base` has what the patterns find, `spans` those and what the field adds, which never overlaps a base span.  A null text is
    empty and has no spans.  Rows that repeat are scanned one by one.  Very long runs are read once, and islands as they are.
    An empty table gives an empty result (the field is then fitted on made examples only).  Other columns are not read.
    """
    scanned = settle(scan(docs, id_column, text_column), "scanned")
    field = fit(scanned, sample)

    def run(batches):
        for part in slices(batches, 1024):
            base = part.column(1).to_pylist()
            rest = [[x for x in r if x["open"]] for r in part.column(2).to_pylist()]
            texts = [x["text"] for r in rest for x in r]
            taken = [[(s["start"] - x["start"], s["end"] - x["start"]) for s in b
                      if s["end"] > x["start"] and s["start"] < x["start"] + len(x["text"])] for b, r in zip(base, rest) for x in r]
            more = iter(added_spans(field, texts, taken))
            spans = []
            for b, r in zip(base, rest):
                all_ = [(s["start"], s["kind"], s["end"]) for s in b]
                for x in r:
                    all_ += [(x["start"] + a, k, x["start"] + e) for a, k, e in next(more)]
                spans.append([{"start": a, "kind": k, "end": e} for a, k, e in sorted(all_)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.list_(_SPAN))], ["id", "base", "spans"])

    kind = "array<struct<start:long,kind:int,end:long>>"
    return scanned.mapInArrow(run, f"id long, base {kind}, spans {kind}")


def listed(spans):
    """Column: `kind:start:end` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def digests(found):
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and hash of the base spans, text of all."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))

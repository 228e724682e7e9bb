"""Published versions of several tables at once: staged data, then one marker.

A store is a folder.  Data go to fresh folders below `data`; a version becomes real when its marker, a small JSON file
that lists every table's folders, appears below `versions`.  The marker is written under another name and renamed, and a
rename never replaces a file, so of two writers one fails with `Conflict` and no version is lost.  A job that fails before the
rename leaves no table changed: neither a result without its ledger rows nor rows without a result.  Readers take the newest
marker, so a table can be replaced by a query over itself.
"""

import json
import uuid

#: Digits of a version in its marker's name; names sort as numbers do.
_DIGITS = 12


class Conflict(RuntimeError):
    """Another writer published the version this one was built for."""


def _files(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark, folder):
    system, path = _files(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def versions(spark, store):
    """Numbers of all published versions, oldest first."""
    return [int(n[:_DIGITS]) for n in _names(spark, f"{store}/versions") if n.endswith(".json") and n[:_DIGITS].isdigit()]


def manifest(spark, store, version=None):
    """{table: folders} of a version, by default the newest; empty if nothing is published."""
    known = versions(spark, store)
    if version is None:
        if not known:
            return {}
        version = known[-1]
    elif version not in known:
        raise ValueError(f"no version {version} in {store}")
    system, path = _files(spark, f"{store}/versions/{version:0{_DIGITS}d}.json")
    stream = system.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_published(spark, store, table, version=None):
    """A table as the version has it; None if the version does not list it."""
    folders = manifest(spark, store, version).get(table)
    return spark.read.parquet(*[f"{store}/data/{f}" for f in folders]) if folders else None


def _mark(spark, store, version, tables):
    system, place = _files(spark, f"{store}/versions")
    system.mkdirs(place)
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(f"{store}/versions/.{uuid.uuid4().hex}.draft")
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    stream.close()
    goal = hadoop.Path(f"{store}/versions/{version:0{_DIGITS}d}.json")
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() \
        else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, goal, option)
    except Exception as error:
        system.delete(draft, False)
        if system.exists(goal):
            raise Conflict(f"version {version} of {store} is already published") from error
        raise


def publish(spark, store, replace=None, append=None, base=None):
    """Write tables and publish them as one version; returns its number.

    `replace` and `append` are {table: DataFrame}; tables of neither stay as they are.  `base` is the version the frames
    were read from, by default the newest now; if another one was published since, this raises `Conflict`, and the
    written folders are leftovers for `drop_leftovers`.
    """
    replace, append = replace or {}, append or {}
    known = versions(spark, store)
    base = (known[-1] if known else 0) if base is None else base
    tables = manifest(spark, store, base) if base else {}
    for mode, frames in (("replace", replace), ("append", append)):
        for name, df in frames.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{store}/data/{folder}")
            tables[name] = [folder] if mode == "replace" else [*tables.get(name, []), folder]
    _mark(spark, store, base + 1, tables)
    return base + 1


def drop_leftovers(spark, store, keep=1):
    """Delete data that none of the newest `keep` versions lists, and older markers; call it when nobody writes."""
    known = versions(spark, store)
    kept = known[-keep:]
    used = {f for v in kept for folders in manifest(spark, store, v).values() for f in folders}
    gone = [f"{store}/data/{n}" for n in _names(spark, f"{store}/data") if n not in used]
    gone += [f"{store}/versions/{v:0{_DIGITS}d}.json" for v in known if v not in kept]
    for place in gone:
        system, path = _files(spark, place)
        system.delete(path, True)
    return len(gone)

"""An index directory: segments of Parquet tables and a versioned list of them.

<dir>/segments/<id>/{docs,postings,terms,norms}   tables of one segment
<dir>/deletes/<id>                                 documents that are gone from the segments of their time
<dir>/segments_<N>                                 JSON; the highest N that is whole is the index

A commit writes its tables first, under new names, and then creates the new list; the creation is
exclusive, so of two writers one fails, and a list that was not written to its end is no version, so a reader sees a
whole version or the one before. The list holds each segment's statistics by field; an index's are their
sums, so opening one runs no job, and scores don't hang on how documents were dealt to segments.
Postings are runs: each file holds one field's postings of a bounded share of the documents, sorted by
(term, doc), with bloom filters and page indexes of terms, so a search reads the pages of its terms of each
file. Postings are never shuffled: a run is made of its documents by one task, and fits its memory.

Documents are numbered by a whole-number key itself, or from the segment's base by the rank of their
key: bases follow one another, so no two segments share a number. A delete counts for the segments
that stood when it was committed, so a document that comes back later is there. As in other engines
statistics forget deleted documents when segments are merged.
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields as fields_
from ..operators.fields import Field, checked
from ..operators.index import NORMS, POSTINGS, SearchIndex, all_norms, all_postings, check_stats, is_number, source_text, stat_table, summary, term_table, with_doc

#: Bytes of text, and of postings' files when merged, that one task makes a run of.
RUN_BYTES = 16 << 20
#: Deleted documents up to which they are broadcast to the tables that they are taken from.
FEW_DELETES = 2_000_000
STATS = "field string, max_doc long, doc_count long, sum_ttf long, sum_df long, min_term string, max_term string"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(m[1]) for x in names if (m := re.fullmatch(r"segments_(\d+)", x)))

    def manifest(self, version: int | None = None) -> dict:
        for n in reversed(self.versions()) if version is None else [version]:
            stream = self._fs.open(self._at(f"segments_{n}"))
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:  # being written, or its writer died
                if version is not None:
                    raise
            finally:
                stream.close()
        return {"segments": [], "fields": [], "deletes": [], "next_doc": 0}

    def _commit(self, manifest: dict) -> int:
        version = (self.versions() or [0])[-1] + 1
        try:
            out = self._fs.create(self._at(f"segments_{version}"), False)
        except Py4JJavaError as e:
            raise RuntimeError("another writer has committed this version") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return version

    def _write_segment(self, docs: DataFrame, fields: list[Field], label: str | None, merged: tuple[DataFrame, DataFrame] | None = None) -> dict | None:
        """A segment's tables under a new name. merged: its postings and norms, if they are known already."""
        name = uuid.uuid4().hex
        base = f"{self.path}/segments/{name}"
        docs.write.parquet(f"{base}/docs")
        docs = self.spark.read.parquet(f"{base}/docs")
        text = [F.coalesce(F.octet_length(source_text(docs, f)), F.lit(0)) for f in fields if f.tokenized]
        n, distinct, size = docs.agg(F.count("*"), F.count_distinct("doc"), F.sum(reduce(Column.__add__, text, F.lit(64)).cast("long"))).first()
        if n != distinct or not n:
            self._fs.delete(self._at(f"segments/{name}"), True)
            if n != distinct:
                raise ValueError(f"documents share an id, or have none: {n} rows, {distinct} ids")
            return None
        options = {"parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.adaptive.enabled": "true", "compression": "zstd"}
        if merged:
            with self._small_splits():
                runs = merged[0].withColumn("head", F.lit(None).cast("boolean")).sortWithinPartitions("field", "term", "doc")
                runs.write.options(**options).parquet(f"{base}/postings")
        else:  # field by field: sorting begins with what differs
            shares = docs.repartition(-(-int(size) // RUN_BYTES), "doc")
            for one in [[f] for f in fields if f.level != "none"] or [[]]:
                all_postings(shares, one).sortWithinPartitions("term", "doc").write.options(**options).mode("append").parquet(f"{base}/postings")
        post = self.spark.read.schema(f"{POSTINGS}, head boolean").parquet(f"{base}/postings")
        if merged:
            norms = merged[1]
        else:  # a text's length stands at the term that it begins with
            norms = post.where("head").select("field", "doc", "dl", "dl_q").unionByName(all_norms(docs, [f for f in fields if not f.tokenized]))
        norms.write.parquet(f"{base}/norms")
        norms = self.spark.read.schema(NORMS).parquet(f"{base}/norms")
        term_table(post).sortWithinPartitions("field", "term").write.parquet(f"{base}/terms")
        terms = self.spark.read.parquet(f"{base}/terms")
        stats = [r.asDict() for r in stat_table(norms, terms, n).collect()]  # a row per field
        for x in stats:
            check_stats(x)
        return {"name": name, "label": label or name, "max_doc": n, "stats": [{k: v for k, v in x.items() if k not in ("max_doc", "max_df")} for x in stats]}

    @contextmanager
    def _small_splits(self):
        """Files are read in tasks of RUN_BYTES, small ones together, so that what a task reads it can sort in memory."""
        want = {"spark.sql.files.maxPartitionBytes": str(RUN_BYTES), "spark.sql.files.openCostInBytes": "65536"}
        was = {k: self.spark.conf.get(k) for k in want}
        try:
            for k, v in want.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)

    def write(self, df: DataFrame, key, fields: list[Field], mode: str = "overwrite", segment: str | None = None) -> int | None:
        """Index df as a new segment; overwrite starts anew, append adds, update adds and deletes what the index
        holds under the same keys. None if there was no document.

        A segment of the same name (`segment`) is replaced, so a retried batch is not indexed twice. Whole-number keys
        that the index holds already can be updated but not appended.
        """
        fields = checked(fields)
        now = self.manifest() if mode != "overwrite" else {"segments": [], "fields": [], "deletes": [], "next_doc": 0}
        if now["fields"] and {f.name: f.shape() for f in map(_field, now["fields"])} != {f.name: f.shape() for f in fields}:
            raise ValueError("appended fields differ in shape from the index's")
        keep = [s for s in now["segments"] if segment is None or s["label"] != segment]
        done = self._write_segment(with_doc(df, key, now["next_doc"]), fields, segment)
        if done is None:
            return None
        deletes = now["deletes"]
        if keep:
            keys = [key] if isinstance(key, str) else key
            new = self.spark.read.parquet(f"{self.path}/segments/{done['name']}/docs").select(*keys)
            held = self._live({**now, "segments": keep}, "docs").join(new, keys, "left_semi").select("doc")
            if mode == "update":
                deletes = [*deletes, self._deleted(held, keep)]
            elif is_number(df, key) and not held.isEmpty():
                raise ValueError("the index holds some of these ids already: update them")
        numbers = 0 if is_number(df, key) else done["max_doc"]
        return self._commit({"segments": [*keep, done], "fields": [vars(f) for f in fields], "deletes": deletes, "next_doc": now["next_doc"] + numbers})

    def update(self, df: DataFrame, key, fields: list[Field], segment: str | None = None) -> int | None:
        """Delete the documents with df's keys and add df, in one commit."""
        return self.write(df, key, fields, "update", segment)

    def _deleted(self, docs: DataFrame, segments: list[dict]) -> dict:
        name = f"deletes/{uuid.uuid4().hex}"
        docs.select("doc").distinct().write.parquet(f"{self.path}/{name}")
        n = self.spark.read.parquet(f"{self.path}/{name}").count()
        return {"path": name, "n": n, "segments": [s["name"] for s in segments]}

    def delete(self, docs: DataFrame) -> int:
        """Mark docs (column doc) as deleted from the segments that are there now; merge() takes them out."""
        now = self.manifest()
        return self._commit(now | {"deletes": [*now["deletes"], self._deleted(docs, now["segments"])]})

    def merge(self) -> int | None:
        """All segments as one, without what is deleted. Postings are taken over, no text is analyzed again."""
        now = self.manifest()
        fields = [_field(f) for f in now["fields"]]
        done = self._write_segment(self._live(now, "docs"), fields, None, (self._live(now, "postings"), self._live(now, "norms"))) if now["segments"] else None
        return self._commit(now | {"segments": [done] if done else [], "deletes": []})

    def _live(self, now: dict, table: str) -> DataFrame:
        """A table of all segments, each without the documents deleted from it."""
        schema = {"postings": POSTINGS, "norms": NORMS}.get(table)
        read = self.spark.read.schema(schema) if schema else self.spark.read
        of: dict[tuple, list[str]] = {}  # deletes -> segments
        size = {d["path"]: d.get("n", FEW_DELETES + 1) for d in now["deletes"]}
        for s in now["segments"]:
            of.setdefault(tuple(d["path"] for d in now["deletes"] if s["name"] in d["segments"]), []).append(f"{self.path}/segments/{s['name']}/{table}")
        parts = []
        for deletes, paths in of.items():
            rows = read.parquet(*paths)
            if deletes:  # few are broadcast, many are hashed: the table itself is not sorted for it
                gone = self.spark.read.parquet(*[f"{self.path}/{d}" for d in deletes])
                rows = rows.join(gone.hint("broadcast" if sum(size[d] for d in deletes) <= FEW_DELETES else "shuffle_hash"), "doc", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def open(self, version: int | None = None, only: str = "") -> SearchIndex:
        """The index, of the last or a given version; only: the segments whose names begin so."""
        now = self.manifest(version)
        now["segments"] = [s for s in now["segments"] if s["label"].startswith(only)]
        if not now["segments"]:
            raise FileNotFoundError(f"no index at {self.path}" + f" with segments {only}..." * bool(only))
        terms = self.spark.read.parquet(*[f"{self.path}/segments/{s['name']}/terms" for s in now["segments"]])
        if len(now["segments"]) > 1:
            terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
        fields = [_field(f) for f in now["fields"]]
        stats = self.spark.createDataFrame(_summed(now["segments"]), STATS)
        return SearchIndex(self.spark, fields, self._live(now, "docs"), self._live(now, "postings"), terms, stats, norms=self._live(now, "norms"))

    def summary(self) -> DataFrame:
        """segment, json: the counts of each field of each segment."""
        out = None
        for s in self.manifest()["segments"]:
            rows = summary(self.open(only=s["label"]))
            one = rows.select(F.lit(s["label"]).alias("segment"), F.to_json(F.struct(*rows.columns)).alias("json"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise FileNotFoundError(f"no index at {self.path}")
        return out


def _summed(segments: list[dict]) -> list[tuple]:
    """The statistics of all segments by field. Terms compare by code points, which is their bytes' order."""
    by: dict[str, list[dict]] = {}
    for s in segments:
        for x in s["stats"]:
            by.setdefault(x["field"], []).append(x)
    max_doc = sum(s["max_doc"] for s in segments)
    total = lambda xs, k: sum(x[k] for x in xs)
    return [(f, max_doc, total(xs, "doc_count"), total(xs, "sum_ttf"), total(xs, "sum_df"), min(x["min_term"] for x in xs), max(x["max_term"] for x in xs)) for f, xs in by.items()]


def _field(x: dict) -> Field:
    return fields_.Field(**x)

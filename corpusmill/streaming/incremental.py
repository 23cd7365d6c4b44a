"""Incremental compilation: files in micro-batches, content by reference counts, pages by what changed.

Tables are Parquet folders partitioned by batch. A batch adds its own rows and last its number to
``commits``: readers see the batches listed there, so a batch that fails leaves the old state, and
one that is run again replaces what it left. ``compact`` writes what is live into a new generation
of folders, which the last row of ``generations`` makes the current one.

* ``paths`` holds signed rows: a file (path, content hash and the file's own facts) counts +1 when
  it comes and -1 when it goes; a content lives while its counts add up to more than nothing, under
  the first of its live paths. ``texts`` has each content once.
* ``sources``, ``blocks``, ``evidence``, ``units``, ``chunks`` and ``mentions`` belong to a source id;
  ``tombstones`` retracts all rows of earlier batches under an id.
* ``claims`` and ``pages`` are kept by key: the latest batch's row of a key stands, unless it says
  that the key is dead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import claims as C
from ..operators import compile as B
from ..operators import concepts as K
from ..operators import pages as P
from ..operators import structure as S
from ..sources.stages import staged

#: Tables whose rows belong to a source, and tables of one row for each key, with their keys.
TABLES = ("sources", "blocks", "evidence", "units", "chunks", "mentions")
KEYED = {"claims": "normalized_text", "pages": "page_key"}
#: What identifies a file besides its content; a change of any is a change of the file.
FILE = ("source_path", "source_hash", "source_type", "ord", "title")


class Store:
    """Tables by batch on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.base = spark, root.rstrip("/")

    def _read(self, path: str) -> DataFrame | None:
        """A table as it lies, None before its first row."""
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    @property
    def generation(self) -> int:
        found = self._read(f"{self.base}/generations")
        return 0 if found is None else found.agg(F.max("generation")).first()[0]

    @property
    def root(self) -> str:
        n = self.generation
        return f"{self.base}/g{n}" if n else self.base

    def _all(self, name: str) -> DataFrame | None:
        return self._read(f"{self.root}/{name}")

    def last(self) -> int:
        """The number of the latest batch, -1 before the first."""
        commits = self._all("commits")
        return -1 if commits is None else commits.agg(F.max("batch")).first()[0]

    def _finished(self, name: str) -> DataFrame | None:
        commits, rows = self._all("commits"), self._all(name)
        if commits is None or rows is None:
            return None
        return rows.join(F.broadcast(commits.select("batch")), "batch", "left_semi")  # a row for each batch since the last compaction

    def read(self, name: str) -> DataFrame | None:
        """Live rows of a table of finished batches."""
        rows = self._finished(name)
        if rows is None:
            return None
        if name in KEYED:
            latest = rows.groupBy(KEYED[name]).agg(F.max("batch").alias("batch"))
            return rows.join(latest, [KEYED[name], "batch"], "left_semi").where("NOT dead").drop("batch", "dead")
        gone = self._finished("tombstones") if name in TABLES else None
        if gone is not None:
            gone = gone.groupBy("source_id").agg(F.max("batch").alias("gone_at"))
            rows = rows.join(gone, "source_id", "left").where("gone_at IS NULL OR batch >= gone_at").drop("gone_at")
        return rows.drop("batch")

    def files(self) -> DataFrame | None:
        """Live files: FILE and how often each is counted."""
        rows = self._finished("paths")
        return None if rows is None else rows.groupBy(*FILE).agg(F.sum("n").alias("n")).where("n > 0")

    def write(self, name: str, rows: DataFrame, batch: int, root: str | None = None) -> None:
        """A batch's rows of a table, in place of any under its number."""
        rows.withColumn("batch", F.lit(batch)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root or self.root}/{name}")

    def commit(self, tables: dict[str, DataFrame], batch: int) -> int:
        """Write a batch's tables, then its number. Tables must not be read from what they are written to."""
        for name in (*TABLES, *KEYED, "paths", "texts", "tombstones"):  # what a failed run left
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch={batch}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        for name, rows in tables.items():
            self.write(name, rows, batch)
        self.spark.createDataFrame([(batch,)], "batch int").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return batch

    def compact(self) -> int | None:
        """Write what is live as one batch of a new generation; its number, or None for an empty store. A failed run leaves the old one current."""
        batch, n = self.last(), self.generation + 1
        if batch < 0:
            return None
        root = f"{self.base}/g{n}"
        for name in (*TABLES, *KEYED, "texts"):
            rows = self.read(name)
            if rows is not None:
                rows = rows.join(self.files().select("source_hash").distinct(), "source_hash", "left_semi") if name == "texts" else rows
                self.write(name, rows.withColumn("dead", F.lit(False)) if name in KEYED else rows, batch, root)
        self.write("paths", self.files(), batch, root)
        self.spark.createDataFrame([(batch,)], "batch int").coalesce(1).write.mode("overwrite").parquet(f"{root}/commits")
        self.spark.createDataFrame([(n,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.base}/generations")
        return n


def _ids(files: DataFrame) -> DataFrame:
    return files.withColumn("source_id", ids.source_id(F.col("source_path"), F.col("source_hash")))


def register(scan: DataFrame, files: DataFrame | None, full: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed files, sources to compile: FILE and source_id, source ids to retract).

    A path has one row in a scan, its latest (then the greatest hash). Paths that the scan names
    lose what they held before; with ``full``, so do paths that it doesn't name. Contents move to
    the first of their live paths: one whose first file changes is retracted and compiled anew.
    """
    latest = Window.partitionBy("source_path").orderBy(F.desc("ord"), F.desc("source_hash"))
    now = scan.withColumn("_r", F.row_number().over(latest)).where("_r = 1").withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_type", "title")}).withColumn("ord", F.coalesce(F.col("ord"), F.lit(0)).cast("long")).select(*FILE)
    if files is None:
        files = now.limit(0).withColumn("n", F.lit(0).cast("long"))
    old = files.select(*FILE)
    come, same = now.join(old, [*FILE], "left_anti"), now.join(old, [*FILE], "left_semi")
    left = old if full else old.join(now.select("source_path"), "source_path", "left_semi")
    gone = left.join(same, [*FILE], "left_anti")
    signed = come.withColumn("n", F.lit(1).cast("long")).unionByName(gone.withColumn("n", F.lit(-1).cast("long")))
    signed = staged(signed, "signed")  # narrow rows, read several times
    touched = signed.select("source_hash").distinct()
    before = files.join(touched, "source_hash", "left_semi").select(*FILE, "n")
    after = before.unionByName(signed).groupBy(*FILE).agg(F.sum("n").alias("n")).where("n > 0")
    first = lambda rows: _ids(rows.groupBy("source_hash").agg(F.min(F.struct("source_path", "source_type", "ord", "title")).alias("f")).select("source_hash", "f.*"))
    was, is_ = first(before), first(after)
    key = ["source_id", *FILE]
    return signed, is_.select(*key).join(was.select(*key), key, "left_anti"), was.select(*key).join(is_.select(*key), key, "left_anti").select("source_id")


def compile_batch(fresh: DataFrame) -> dict[str, DataFrame]:
    blocks, evidence, units = S.compile_structure(fresh)
    units, chunks = staged(units, "units"), staged(S.chunks(fresh), "chunks")
    return {"sources": fresh, "blocks": blocks, "evidence": evidence, "units": units, "chunks": chunks, "mentions": C.claims(units, chunks)}


def apply_batch(store: Store, scan: DataFrame, full: bool = False, compiled: Callable[[DataFrame], dict[str, DataFrame]] = compile_batch, pages: bool = False) -> int | None:
    """Bring the store up to a scan of files; the number of the batch made, or None where nothing changed.

    ``full``: the scan has all files there are. ``pages``: claims and pages are kept up too.
    """
    signed, fresh, gone = register(scan, store.files(), full)
    if signed.isEmpty():
        return None
    fresh, gone = staged(fresh, "fresh"), staged(gone, "gone")
    texts = store.read("texts")
    new = scan.select("source_hash", "text").join(fresh.select("source_hash"), "source_hash", "left_semi").dropDuplicates(["source_hash"])
    new = staged(new if texts is None else new.join(texts.select("source_hash"), "source_hash", "left_anti"), "texts")
    held = new if texts is None else new.unionByName(texts.join(fresh.select("source_hash"), "source_hash", "left_semi"))
    tables = {name: staged(rows, name) for name, rows in compiled(staged(fresh.join(held, "source_hash"), "sources")).items()}
    tables |= {"paths": signed, "texts": new, "tombstones": gone}
    if pages:
        tables |= page_delta(store, tables)
    return store.commit(tables, store.last() + 1)


def _without(rows: DataFrame | None, gone: DataFrame, new: DataFrame) -> DataFrame:
    """A table of sources as it will be: old rows but those of retracted sources, and new ones."""
    return new if rows is None else rows.join(gone, "source_id", "left_anti").unionByName(new, allowMissingColumns=True)


def made_pages(sources: DataFrame, chunks: DataFrame, claims: DataFrame, shown: DataFrame, evidence: DataFrame, names: DataFrame) -> DataFrame:
    """Pages of sources and of claims' groups, with ``page_key``: the source's id or the group. ``shown``: the claims that source pages list; ``names``: (source_id, source_path, title) of all sources."""
    found = B.routed_groups(claims, evidence)
    made = B.group_pages(found, names)
    # a claim stands in one group
    key = found["groups"].select(F.col("claim_id").alias("_c"), F.concat(F.lit("group:"), "group").alias("page_key"))
    made = made.join(key, F.get("claim_ids", F.lit(0)) == F.col("_c")).drop("_c")
    own = P.source_pages(sources, shown, chunks)
    return made.unionByName(own.withColumn("page_key", F.concat(F.lit("source:"), F.get("source_ids", F.lit(0)))))


def page_delta(store: Store, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of ``claims`` and ``pages`` that a batch changes, dead ones included.

    Mentions that come or go touch texts; touched texts are merged anew from their live mentions;
    claims that differ touch their old and new groups and the sources that name them; pages of
    touched groups and sources are made anew, and written only if they differ. The overview follows
    when any page did. All else stays as it lies.
    """
    gone, old_mentions, old_claims, old_pages = new["tombstones"], store.read("mentions"), store.read("claims"), store.read("pages")
    lost = None if old_mentions is None else old_mentions.join(gone, "source_id", "left_semi").select("normalized_text", "source_id")
    texts = new["mentions"].select("normalized_text")
    texts = staged((texts if lost is None else texts.unionByName(lost.select("normalized_text"))).distinct(), "touched_texts")
    mentions = _without(old_mentions, gone, new["mentions"])
    merged = staged(C.merge_claims(mentions.join(texts, "normalized_text", "left_semi")), "merged")
    before = merged.limit(0) if old_claims is None else staged(old_claims.join(texts, "normalized_text", "left_semi").select(merged.columns), "claims_before")
    sign = F.xxhash64(*(c for c in merged.columns))
    changed = merged.withColumn("_s", sign).join(before.select("normalized_text", sign.alias("_s")), ["normalized_text", "_s"], "left_anti").drop("_s")
    dead = before.join(merged.select("normalized_text"), "normalized_text", "left_anti")
    delta = staged(changed.withColumn("dead", F.lit(False)).unionByName(dead.withColumn("dead", F.lit(True))), "claim_delta")
    moved = delta.select("normalized_text")
    claims = delta.where("NOT dead").drop("dead")
    claims = staged(claims if old_claims is None else claims.unionByName(old_claims.join(moved, "normalized_text", "left_anti")), "claims_now")
    touched = before.join(moved, "normalized_text", "left_semi").unionByName(delta.where("NOT dead").drop("dead"))
    groups = staged(K.grouped(before.unionByName(merged)).select("group").distinct(), "touched_groups")  # also of claims whose sources have new titles
    named = touched.select(F.explode("source_ids").alias("source_id")).unionByName(new["sources"].select("source_id")).unionByName(gone).distinct()
    named = staged(named, "touched_sources")
    sources = _without(store.read("sources"), gone, new["sources"])
    names, sources = sources.select("source_id", "source_path", "title"), sources.join(named, "source_id", "left_semi")
    evidence = _without(store.read("evidence"), gone, new["evidence"])
    chunks = _without(store.read("chunks"), gone, new["chunks"]).join(named, "source_id", "left_semi")
    of_groups = K.grouped(claims).join(groups, "group", "left_semi").select(claims.columns)
    shown = claims.where(F.size("source_ids") > 0).join(claims.select("claim_id", F.explode("source_ids").alias("source_id")).join(named, "source_id", "left_semi").select("claim_id").distinct(), "claim_id", "left_semi")
    made = staged(made_pages(sources, chunks, of_groups, shown, evidence, names), "pages_made")
    keys = groups.select(F.concat(F.lit("group:"), "group").alias("page_key")).unionByName(named.select(F.concat(F.lit("source:"), "source_id").alias("page_key")))
    sign = ids.signature("title", "type", "status", "summary", "page_text")
    made = made.withColumn("signature", sign)
    if old_pages is None:
        old_pages = made.limit(0)
    same = ["page_key", "page_path", "signature", "claim_ids", "source_ids", "route_decision_id"]
    moved = staged(made.join(old_pages.select(*same), same, "left_anti"), "pages_moved")
    over = staged(old_pages.join(keys, "page_key", "left_semi").join(made.select("page_key"), "page_key", "left_anti"), "pages_over")
    rest = old_pages.join(moved.select("page_key").unionByName(over.select("page_key")), "page_key", "left_anti").where("page_key <> 'overview'")
    concepts = rest.unionByName(moved).where("type <> 'source-summary'").drop("page_key", "signature")
    overview = P.overview_page(concepts).withColumn("page_key", F.lit("overview")).withColumn("signature", sign)
    moved = moved.unionByName(overview.join(old_pages.select("page_key", "signature"), ["page_key", "signature"], "left_anti"))
    over = over.unionByName(old_pages.where("page_key = 'overview'").join(overview.select("page_key"), "page_key", "left_anti"))
    rows = moved.withColumn("dead", F.lit(False)).unionByName(over.withColumn("dead", F.lit(True)))
    return {"claims": delta, "pages": staged(rows, "page_delta")}


def tombstones(store: Store, scan: DataFrame) -> int | None:
    """Retract files whose path the scan no longer has; what it adds or changes waits for ``apply_batch``."""
    files = store.files()
    if files is None:
        return None
    kept = files.join(scan.select("source_path"), "source_path", "left_semi").select(*FILE)
    texts = store.read("texts")
    return apply_batch(store, kept.join(texts, "source_hash"), full=True)


def merged_claims(store: Store) -> DataFrame:
    """Claims of the store's mentions, exact repeats merged."""
    return C.merge_claims(store.read("mentions"))


def start(spark: SparkSession, source, store: Store, checkpoint: str):
    """Run a stream of sources into the store until what is available is done. ``source``: a streaming frame with the columns of a scan."""
    return source.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

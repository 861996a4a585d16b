"""A store of memories: one Parquet folder a table version, changed by writing a new version and moving a pointer.

A change writes whole new versions of the tables it touches, then replaces the file that names them all, so readers
see all of it or nothing. The pointer is a small text file that is replaced by a rename of the store's own file system.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import models, scoring, splitting
from ..functions import text as T
from ..sources import schemas
from . import duplicates, fusion, graph, maintenance, vectors
from .common import settled, small, top


class Store:
    """Tables under `path` (any folder that Spark writes to). Calls that change take `as_of`."""

    def __init__(self, spark: SparkSession, path: str, embed=None):
        self.spark, self.path = spark, path.rstrip("/")
        self.embed = models.embedder_udf(embed)

    # files
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[str, str]:
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])

    def table(self, name: str) -> DataFrame:
        own = self.versions().get(name)
        if own is None:
            return self.spark.createDataFrame([], schemas.schema(name))
        return schemas.conform(self.spark.read.parquet(f"{self.path}/{own}"), name)

    def commit(self, **tables: DataFrame) -> None:
        """New versions of the given tables, visible together. Fails if another writer moved the pointer meanwhile."""
        before = self.versions()
        now = dict(before)
        for name, df in tables.items():
            version = f"{name}-{uuid.uuid4().hex}"
            schemas.conform(df, name).write.parquet(f"{self.path}/{version}")
            now[name] = version
        if self.versions() != before:
            raise RuntimeError("another writer changed the store: read again and repeat the change")
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        fresh = path(f"{self.path}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, path(f"{self.path}/CURRENT"), over)

    # changes
    def add(self, rows: DataFrame, as_of: str, dedup: bool = True, score: Column | None = None, contradict: Column | None = None, mode: str = "rerank", setting: tuple[str, str] | None = None) -> DataFrame:
        """Stores rows(content, project, ...) and returns (row, id, status, existing_id, confidence, methods, warnings).

        Chains become lines, texts over the threshold become chained children. A row that duplicates an active one is
        not stored: candidates come by words, subject and vector, and count by `score` (an expression of query and content) if
        given, else by distance or overlap. Among the new rows the first of equal texts stays. With `contradict`, an
        expression alike, near rows of the project give warnings and links. All of it, and a setting, is one commit.
        """
        old = self.table("memories")
        base = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        numbered = rows.withColumn("row", F.row_number().over(W.orderBy(F.monotonically_increasing_id())).cast("long"))
        new = numbered.select("row", *[c for c in numbered.columns if c in old.columns and c != "id"])
        # ids of new rows are negative until they are stored: no old row has them
        new = schemas.coerce(schemas.conform(new.withColumn("id", -F.col("row")), "memories")).withColumn("content", splitting.explode_udf(F.trim("content")))
        new = new.withColumn("parts", F.when(F.col("consolidation_lock") == 0, splitting.split_udf("content")).otherwise(F.array("content")))
        new = new.withColumn("own", F.row_number().over(W.partitionBy(F.sha2(F.encode("content", "UTF-8"), 256), "project").orderBy(F.desc("id")))).persist()
        asked = new.select(F.col("id").alias("query_id"), F.col("content").alias("query"), "project")
        vectors_ = self._embedded(new, as_of).select(F.col("id").alias("query_id"), "embedding")
        known = self.table("embeddings").where("tier = 'active'")
        twin = self._twins(old, known, asked, vectors_, score) if dedup and base else self.spark.createDataFrame([], "query_id long, existing_id long, confidence double, methods array<string>")
        again = F.col("existing_id").isNotNull() | ((F.col("own") > 1) & F.lit(dedup))
        status = F.when(F.col("content") == "", "rejected").when(again, "duplicate").when(F.size("parts") > 1, "stored-split").otherwise("stored")
        told = new.join(twin, F.col("id") == F.col("query_id"), "left").drop("query_id").withColumn("outcome", status).persist()
        kept = told.where("outcome like 'stored%'").select("*", F.posexplode("parts").alias("at", "piece")).withColumn("of", F.size("parts"))
        kept = kept.withColumn("row", -F.col("id")).withColumn("id", (F.lit(base) + F.row_number().over(W.orderBy("row", "at"))).cast("long")).withColumn("content", F.col("piece"))
        tags = F.when(F.col("of") > 1, F.concat_ws(",", F.when(F.col("tags") != "", F.col("tags")), F.concat(F.lit("split-part:"), (F.col("at") + 1).cast("string"), F.lit("/"), F.col("of").cast("string")), F.lit("nyx-split"))).otherwise(F.col("tags"))
        kept = kept.withColumns({"tags": tags, "created_at": F.coalesce("created_at", scoring.stamp(as_of)), "updated_at": scoring.stamp(as_of)}).persist()
        links = graph.chain(kept.where("of > 1").select("id", F.col("row").alias("g"), "at"), "g", "at").withColumn("created_at", scoring.stamp(as_of))
        warnings = self.spark.createDataFrame([], "row long, warnings array<struct<id: bigint, similarity: double, classification: string, suggested_action: string>>")
        if contradict is not None and base:
            found = self._contradictions(old, known, asked, vectors_, contradict, mode).persist()
            warnings = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("target", "w.similarity", "w.classification", "w.suggested_action").cast(warnings.schema["warnings"].dataType.elementType))).alias("warnings"))
            firsts = kept.where("at = 0").select("row", "id")
            links = links.unionByName(found.join(firsts, "row").select(F.col("id").alias("source_id"), F.col("target").alias("target_id"), F.col("w.classification").alias("relation_type"), F.col("w.similarity").alias("strength"), scoring.stamp(as_of).alias("created_at")))
        tables = {"memories": old.unionByName(kept.select(*old.columns)), "links": graph.insert(self.table("links"), links), "embeddings": self.table("embeddings").unionByName(self._embedded(kept, as_of))}
        if setting:
            tables["settings"] = self._with_setting(*setting, as_of)
        self.commit(**tables)
        out = told.select((-F.col("id")).alias("row"), "outcome", "existing_id", "confidence", "methods").join(kept.where("at = 0").select("row", "id"), "row", "left").join(warnings, "row", "left")
        out = settled(out.select("row", "id", F.col("outcome").alias("status"), "existing_id", "confidence", "methods", "warnings"))
        for df in (new, told, kept):
            df.unpersist()
        return out

    def _twins(self, old: DataFrame, known: DataFrame, asked: DataFrame, vectors_: DataFrame, score: Column | None) -> DataFrame:
        """(query_id, existing_id, confidence, methods): the surest active row that each new row repeats."""
        words = duplicates.overlap_candidates(old, asked, threshold=0.6)
        near = vectors.nearest(known, vectors_, 5).where(F.col("distance") < K.DEDUP_DISTANCE * K.DEDUP_WIDEN)
        found = duplicates.unite(fts=words, cml=duplicates.subject_candidates(old, asked), vec=near)
        if score is not None:
            both = found.join(old.select("id", "content"), "id").join(asked.select("query_id", "query"), "query_id")
            sure = duplicates.confirm_by_score(both, score, K.DEDUP_RERANK)
        else:
            alike = words.where(F.col("similarity") >= K.DEDUP_RERANK).join(found.drop("distance"), ["query_id", "id"]).select("query_id", "id", "methods", F.col("similarity").alias("confidence"))
            sure = duplicates.confirm_by_distance(found).unionByName(alike)
        return top(sure, 1, [F.desc("confidence"), F.col("id")], ["query_id"]).select("query_id", F.col("id").alias("existing_id"), "confidence", "methods")

    def _contradictions(self, old: DataFrame, known: DataFrame, asked: DataFrame, vectors_: DataFrame, contradict: Column, mode: str) -> DataFrame:
        """(row, target, w): warnings about active rows of the project that are near and score as related."""
        near = duplicates.gate(old, known, vectors_.join(asked.select("query_id", "project"), "query_id"))
        both = near.join(old.select("id", "content"), "id").join(asked.select("query_id", "query"), "query_id")
        w = duplicates.warning(contradict, mode)
        return both.select((-F.col("query_id")).alias("row"), F.col("id").alias("target"), w.alias("w")).where("w.classification is not null")

    def apply_merge(self, plan: dict[str, DataFrame], as_of: str) -> DataFrame:
        """Carries out consolidation.plan_merge: stores what it creates, chained, archives the sources with a tag that names
        the first part, and notes the lineage, in one commit. Returns (cluster, id of the first part)."""
        old = self.table("memories")
        base = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        made = plan["created"].withColumn("id", (F.lit(base) + F.row_number().over(W.orderBy("cluster", "part"))).cast("long"))
        made = made.withColumns({"created_at": scoring.stamp(as_of), "updated_at": scoring.stamp(as_of)}).persist()
        firsts = made.where("part = 1").select("cluster", F.col("id").alias("first"))
        gone = plan["archived"].join(firsts, "cluster").select("id", F.concat(F.lit("merged-into-"), F.col("first").cast("string")).alias("mark")).persist()
        kept = old.join(gone, "id", "left")
        tags = F.when(F.col("mark").isNull(), F.col("tags")).otherwise(F.concat_ws(",", F.when(F.col("tags") != "", F.col("tags")), F.col("mark")))
        status = F.when(F.col("mark").isNull(), F.col("status")).otherwise("archived")
        kept = kept.withColumns({"tags": tags, "status": status}).select(*old.columns)
        rows = schemas.conform(made, "memories").select(*old.columns)
        lineage = plan["lineage"].join(firsts, "cluster")
        chains = graph.chain(made.where("of > 1").select("id", F.col("cluster").alias("g"), "part"), "g", "part").withColumn("created_at", scoring.stamp(as_of))
        e = self.table("embeddings").join(gone.select("id", "mark"), "id", "left")
        e = e.withColumn("tier", F.when(F.col("mark").isNull(), F.col("tier")).otherwise("archived")).drop("mark")
        self.commit(memories=kept.unionByName(rows), links=graph.insert(self.table("links"), chains), insights=self._with_lineage(lineage, as_of), embeddings=e.unionByName(self._embedded(rows, as_of)))
        out = settled(firsts.withColumnRenamed("first", "id"))
        made.unpersist()
        gone.unpersist()
        return out

    def _with_lineage(self, lineage: DataFrame, as_of: str, kind: str = "merge", how: str = "aggregation") -> DataFrame:
        """insights with a row for each of lineage(first, source_ids)."""
        old = self.table("insights")
        base = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        number = (F.lit(base) + F.row_number().over(W.orderBy("first"))).cast("long")
        new = lineage.select(number.alias("id"), F.col("first").alias("memory_id"), "source_ids", F.lit(kind).alias("insight_type"), F.lit(how).alias("consolidation_type"), scoring.stamp(as_of).alias("created_at"))
        return old.unionByName(new)

    def add_lineage(self, lineage: DataFrame, as_of: str, kind: str = "merge", how: str = "aggregation") -> None:
        """Notes that memory `first` was made of source_ids, for each row of lineage."""
        self.commit(insights=self._with_lineage(lineage, as_of, kind, how))

    def remediate_oversized(self, as_of: str, over: int = K.SPLIT_THRESHOLD, most: int | None = None, dry_run: bool = False) -> dict:
        """Splits active unlocked rows over a length into chained children that inherit their fields and links; archives the originals."""
        old = self.table("memories")
        found = old.join(maintenance.oversized(old, over, most).select("id"), "id", "left_semi").withColumn("parts", splitting.split_udf("content")).persist()
        count = found.agg(F.count("*").alias("n"), F.sum((F.size("parts") > 1).cast("int")).alias("s"), F.sum(F.when(F.size("parts") > 1, F.size("parts"))).alias("c")).first()
        split = count["s"] or 0
        told = {"scanned": count["n"], "split": split, "children_created": count["c"] or 0, "archived": 0 if dry_run else split, "skipped_unsplittable": count["n"] - split, "errors": 0, "dry_run": dry_run, "min_size": over, "max_size": most}
        if split and not dry_run:
            base = old.agg(F.max("id").alias("m")).first()["m"]
            rows = found.where(F.size("parts") > 1).withColumnRenamed("id", "parent").select("*", F.posexplode("parts").alias("at", "piece"))
            rest = F.filter(T.tag_list(F.col("tags")), lambda t: ~t.startswith("split-from:#") & ~t.startswith("split-part:"))
            part = F.concat(F.lit("split-part:"), (F.col("at") + 1).cast("string"), F.lit("/"), F.size("parts").cast("string"))
            tags = F.array_join(F.concat(rest, F.array(part, F.concat(F.lit("split-from:#"), F.col("parent").cast("string")), F.lit("nyx-split"))), ",")
            rows = rows.withColumns({"id": (F.lit(base) + F.row_number().over(W.orderBy("parent", "at"))).cast("long"), "content": splitting.explode_udf("piece"), "tags": tags, "created_at": scoring.stamp(as_of), "updated_at": scoring.stamp(as_of), "access_count": F.lit(0), "last_accessed": F.lit(None).cast("timestamp")}).persist()
            parents = rows.where("at = 0").select("parent", F.col("id").alias("first")).persist()
            chains = graph.chain(rows.select("id", F.col("parent").alias("g"), "at"), "g", "at").withColumn("created_at", scoring.stamp(as_of))
            own = self.table("links")
            for end in ("source_id", "target_id"):  # links of the original go to its first child
                moved = own.join(parents, F.col(end) == F.col("parent")).withColumn(end, F.col("first")).select(*own.columns)
                chains = chains.unionByName(moved.where("source_id <> target_id"))
            gone = parents.select(F.col("parent").alias("id"), F.lit(True).alias("gone"))
            archived = lambda df, c: df.join(gone, "id", "left").withColumn(c, F.when(F.col("gone"), "archived").otherwise(F.col(c))).drop("gone")
            new = rows.select(*old.columns)
            self.commit(memories=archived(old, "status").select(*old.columns).unionByName(new), links=graph.insert(own, chains), embeddings=archived(self.table("embeddings"), "tier").unionByName(self._embedded(new, as_of)))
            rows.unpersist()
            parents.unpersist()
        found.unpersist()
        return told

    def log_run(self, as_of: str, **counts) -> None:
        """Adds a row about a run of consolidation."""
        row = self.spark.createDataFrame([(1,)], "one int").select(scoring.stamp(as_of).alias("run_at"), *[F.lit(v).alias(k) for k, v in counts.items()])
        self.commit(consolidation_log=self.table("consolidation_log").unionByName(schemas.conform(row, "consolidation_log")))

    def log_tools(self, calls: DataFrame) -> None:
        """Adds rows of calls(tool_name, called_at)."""
        self.commit(tool_usage=self.table("tool_usage").unionByName(schemas.conform(calls, "tool_usage")))

    def log_retrieval(self, hits: DataFrame, as_of: str, session: str | None = None) -> None:
        """Adds a row for each hit(query_id, id)."""
        self.commit(retrieval_log=self.table("retrieval_log").unionByName(schemas.conform(fusion.log_of(hits, as_of, session), "retrieval_log")))

    def _embedded(self, memories: DataFrame, as_of: str) -> DataFrame:
        text = T.embed_text(*[F.col(c) for c in ("project", "content", "tags", "type", "layer")])
        rows = memories.select("id", F.when(F.col("status") == "archived", "archived").otherwise("active").alias("tier"), text.alias("t"))
        return rows.select("id", "tier", self.embed(T.map_glyphs(F.col("t"))).alias("embedding"), T.text_hash(F.col("t")).alias("text_hash"), F.lit("hash").alias("model"), scoring.stamp(as_of).alias("embedded_at"))

    def get(self, ids: list[int], as_of: str | None = None) -> DataFrame:
        """Rows by id; with as_of their use is counted, importance may rise, and recent retrievals are marked useful."""
        rows = self.table("memories")
        if as_of is not None:
            hit, now = F.col("id").isin(ids), scoring.stamp(as_of)
            more = F.coalesce("access_count", F.lit(0)) + 1
            rows = rows.withColumns({"importance": F.when(hit, scoring.after_read(F.col("importance"), more)).otherwise(F.col("importance")), "access_count": F.when(hit, more).otherwise(F.col("access_count")), "last_accessed": F.when(hit, now).otherwise(F.col("last_accessed")), "last_confirmed": F.when(hit, now).otherwise(F.col("last_confirmed"))})
            log = self.table("retrieval_log")
            recent = F.col("memory_id").isin(ids) & F.col("useful").isNull() & (scoring.days_since(F.col("retrieved_at"), as_of).between(0, 1))
            self.commit(memories=rows, retrieval_log=log.withColumn("useful", F.when(recent, 1).otherwise(F.col("useful"))))
            rows = self.table("memories")
        return rows.where(F.col("id").isin(ids))

    def update(self, changes: DataFrame, as_of: str) -> None:
        """changes(id, any of the mutable columns): null leaves a value. Vectors follow content, tags, type and layer."""
        cols = [c for c in changes.columns if c in K.MUTABLE]
        old = self.table("memories")
        new = old.join(small(changes.select("id", *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("hit"))), "id", "left")
        new = new.withColumns({c: F.coalesce(F.col(f"n_{c}").cast(dict(old.dtypes)[c]), F.col(c)) for c in cols} | {"updated_at": F.when(F.col("hit"), scoring.stamp(as_of)).otherwise(F.col("updated_at"))})
        new = schemas.coerce(new.select("hit", *old.columns)).persist()
        tables = {"memories": new}
        if {"content", "tags", "type", "layer"} & set(cols):
            tables["embeddings"] = self.table("embeddings").join(changes.select("id"), "id", "left_anti").unionByName(self._embedded(new.where("hit"), as_of))
        self.commit(**tables)
        new.unpersist()

    def delete(self, ids: list[int], hard: bool = False) -> None:
        """Archives rows and moves their vectors to the other tier; `hard` removes rows, vectors and links."""
        m, e = self.table("memories"), self.table("embeddings")
        hit = F.col("id").isin(ids)
        if hard:
            ends = F.col("source_id").isin(ids) | F.col("target_id").isin(ids)
            self.commit(memories=m.where(~hit), embeddings=e.where(~hit), links=self.table("links").where(~ends))
        else:
            self.commit(memories=m.withColumn("status", F.when(hit, "archived").otherwise(F.col("status"))), embeddings=e.withColumn("tier", F.when(hit, "archived").otherwise(F.col("tier"))))

    def rewrite(self, pattern: str, replacement: str, as_of: str, regex: bool = False, condition: Column | None = None, dry_run: bool = True, cap: int = 50) -> DataFrame:
        """The changes of a bulk rewrite; written unless dry_run. More changes than `cap` are refused."""
        found = maintenance.rewrite(self.table("memories"), pattern, replacement, regex, condition).persist()
        if not dry_run:
            if (n := found.count()) > cap:
                raise ValueError(f"{n} rows would change, more than {cap}")
            self.update(found.select("id", "content"), as_of)
        return found.drop("content")

    def fill_embeddings(self, as_of: str) -> int:
        """Vectors for rows without one, in either tier; how many."""
        m, e = self.table("memories"), self.table("embeddings")
        missing = m.join(e.select("id"), "id", "left_anti").persist()
        n = missing.count()
        if n:
            self.commit(embeddings=e.unionByName(self._embedded(missing, as_of)))
        return n

    def put_setting(self, key: str, value: str | None, as_of: str) -> None:
        """Sets a value, or unsets it with None."""
        self.commit(settings=self._with_setting(key, value, as_of))

    def _with_setting(self, key: str, value: str | None, as_of: str) -> DataFrame:
        rest = self.table("settings").where(F.col("key") != key)
        new = self.spark.createDataFrame([(key, value)], "key string, value string").where("value is not null").withColumn("updated_at", scoring.stamp(as_of))
        return rest.unionByName(new)

    def setting(self, key: str) -> str | None:
        row = self.table("settings").where(F.col("key") == key).select("value").first()
        return row["value"] if row else None

    def backup(self, path: str) -> None:
        """All tables as they are now, as a store of its own: written aside, then renamed."""
        jvm, fs = self._fs()
        aside = Store(self.spark, f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}")
        aside.commit(**{name: self.table(name) for name in self.versions()})
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside.path), jvm.org.apache.hadoop.fs.Path(path)):
            raise OSError(f"can't rename to {path}")

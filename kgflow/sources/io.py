"""Readers and writers. Any URI that Hadoop's file systems know will do (local, HDFS, object stores)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_id

TRIPLE = "head string, relation_type string, tail string"
VERDICTS = TRIPLE + ", verdict_qwen string, verdict_gpt string"
INJECTION = "id long, head string, relation_type string, tail string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def keys(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{root}/{name}.parquet")


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """json, csv (header, quotes), txt (column text), parquet or orc; malformed rows become NULLs."""
    if kind == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    r = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return r.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    return {"json": r.json, "parquet": r.parquet, "orc": r.orc}[kind](path)


def named_groups(df: DataFrame, pattern: str, where: dict[str, str] = {}) -> DataFrame:
    """Columns from the named groups of a pattern over the file name; where: regular expressions the groups must match. Files that don't match are skipped."""
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    java = re.sub(r"\(\?P<\w+>", "(", pattern)
    out = df.withColumn("_f", F.element_at(F.split(F.input_file_name(), "/"), -1)).filter(F.col("_f").rlike(java))
    out = out.withColumns({n: F.regexp_extract("_f", java, i + 1) for i, n in enumerate(names)})
    for n, test in where.items():
        out = out.filter(F.col(n).rlike(test))
    return out.drop("_f")


def csv_documents(spark: SparkSession, path: str, schema: str, pattern: str = r".*\.csv$", text: str = "text", title: str | None = None, where: dict[str, str] = {}) -> DataFrame:
    """Documents from a folder of CSV files: text and title columns by name, a hash id over all values if there is none."""
    df = named_groups(read_any(spark, path, "csv", schema), pattern, where)
    if "id" not in df.columns:
        df = df.withColumn("id", hash_id(*[F.col(c) for c in df.columns]))
    df = df.withColumn("text", F.col(text)) if text != "text" else df
    return df.withColumn("title", F.col(title) if title else F.col("id").cast("string"))


def text_documents(spark: SparkSession, path: str, pattern: str = r".*\.txt$", where: dict[str, str] = {}) -> DataFrame:
    """One document per text file; the title is the file name."""
    df = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text").withColumn("title", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return named_groups(df, pattern, where).withColumn("id", hash_id(F.col("title"), F.col("text")))


def xml_paragraphs(df: DataFrame, column: str, tag: str = "abstract") -> DataFrame:
    """df with paragraphs: the texts of all <p> under a tag, markup removed."""
    body = F.regexp_extract(column, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    found = F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return df.withColumn("paragraphs", F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))))


def routed(df: DataFrame, status: str) -> dict[str, DataFrame]:
    """ok, no_access and error rows by HTTP status, the error route taking everything else."""
    s = F.col(status)
    return {"ok": df.filter(s == 200), "no_access": df.filter(s.isin(401, 403)), "error": df.filter(s.isNull() | ~s.isin(200, 401, 403))}


def write_thresholds(df: DataFrame, score: str, thresholds: list[float], path: str) -> None:
    """A CSV folder for each threshold, of the rows scoring at least that."""
    for t in thresholds:
        df.filter(F.col(score) >= t).write.mode("overwrite").option("header", True).csv(f"{path}_{t:g}")


def write_json_rows(df: DataFrame, path: str, by: list[str] = []) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_resumable(df: DataFrame, part: str, path: str) -> None:
    """Writes by partition column, overwriting only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def unfinished(df: DataFrame, part: str, path: str) -> DataFrame:
    """The rows whose partition hasn't been written yet."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(part).distinct(), part, "left_anti")


def unite(parts: list[DataFrame], expected: int | None = None) -> DataFrame:
    """Union of parts by name, with an assertion on the total."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"expected {expected} rows, found {n}")
    return out


def write_vectors(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """id, text, vector, attributes (JSON); rows without a vector are skipped."""
    df.filter("vector IS NOT NULL").write.mode("overwrite" if overwrite else "append").parquet(path)


def cached(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(answers already cached, requests still to be made)."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, node_attributes: list[str] = [], edge_attributes: list[str] = []) -> None:
    """One GraphML file at `path` with the attributes given (numbers as double, all else as string); NULL attributes are left out.

    Executors write the elements as text parts; the file system then puts header, parts and footer together, so no table passes through the driver's memory.
    """
    spark = nodes.sparkSession

    def esc(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def data(prefix: str, names: list[str]) -> Column:
        return F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f'<data key="{prefix}{i}">'), esc(F.col(n).cast("string")), F.lit("</data>")), F.lit("")) for i, n in enumerate(names)])

    def keys_of(df: DataFrame, prefix: str, what: str, names: list[str]) -> str:
        kind = lambda n: "string" if dict(df.dtypes)[n] == "string" else "double"
        return "".join(f'<key id="{prefix}{i}" for="{what}" attr.name="{n}" attr.type="{kind(n)}"/>' for i, n in enumerate(names))

    n = nodes.filter("title IS NOT NULL").select(F.concat(F.lit('<node id="'), esc(F.col("title")), F.lit('">'), data("n", node_attributes), F.lit("</node>")).alias("value"))
    e = edges.filter("source IS NOT NULL AND target IS NOT NULL").select(F.concat(F.lit('<edge source="'), esc(F.col("source")), F.lit('" target="'), esc(F.col("target")), F.lit('">'), data("e", edge_attributes), F.lit("</edge>")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + keys_of(nodes, "n", "node", node_attributes) + keys_of(edges, "e", "edge", edge_attributes) + '<graph edgedefault="undirected">\n'
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out.write(bytearray(head.encode()))
    for no, part in enumerate((n, e)):
        folder = f"{path}._parts{no}"
        part.write.mode("overwrite").text(folder)
        f, p = _fs(spark, folder)
        for status in sorted(f.listStatus(p), key=lambda x: x.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                from_ = f.open(status.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(from_, out, conf, False)
                from_.close()
        f.delete(p, True)
    out.write(bytearray(b"</graph></graphml>\n"))
    out.close()


class Storage:
    """Texts by key under a folder of any Hadoop file system: get, set, has, delete, clear, keys, find, child."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str) -> str:
        if ".." in key.split("/"):
            raise ValueError(f"key {key!r} leads out of the storage")
        return f"{self.root}/{key}"

    def has(self, key: str) -> bool:
        return exists(self.spark, self._at(key))

    def get(self, key: str) -> str | None:
        if not self.has(key):
            return None
        fs, p = _fs(self.spark, self._at(key))
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def set(self, key: str, value: str) -> None:
        fs, p = _fs(self.spark, self._at(key))
        out = fs.create(p, True)
        out.write(bytearray(value.encode()))
        out.close()

    def delete(self, key: str) -> None:
        delete(self.spark, self._at(key))

    def clear(self) -> None:
        delete(self.spark, self.root)

    def keys(self) -> list[str]:
        return keys(self.spark, self.root)

    def find(self, pattern: str, where: dict[str, str] = {}) -> list[tuple[str, dict[str, str]]]:
        """(key, named groups) of the keys that match, as far as each group in `where` matches its own pattern."""
        found = [(k, m.groupdict()) for k in self.keys() if (m := re.search(pattern, k))]
        return [(k, g) for k, g in found if all(re.search(p, g.get(n) or "") for n, p in where.items())]

    def child(self, name: str) -> Storage:
        return type(self)(self.spark, self._at(name))


class MemoryStorage:
    """The same in the memory of the driver, for tests and small state."""

    def __init__(self):
        self.texts: dict[str, str] = {}
        self.children: dict[str, MemoryStorage] = {}

    def has(self, key: str) -> bool:
        return key in self.texts

    def get(self, key: str) -> str | None:
        return self.texts.get(key)

    def set(self, key: str, value: str) -> None:
        self.texts[key] = value

    def delete(self, key: str) -> None:
        self.texts.pop(key, None)

    def clear(self) -> None:
        self.texts.clear()

    def keys(self) -> list[str]:
        return sorted(self.texts)

    find = Storage.find

    def child(self, name: str) -> MemoryStorage:
        return self.children.setdefault(name, MemoryStorage())


class Cache:
    """Answers by key in a storage, as JSON objects {"result": ..}; an entry that can't be read is deleted. Without a storage nothing is kept."""

    def __init__(self, storage: Storage | MemoryStorage | None = None):
        self.storage = storage

    def get(self, key: str):
        text = self.storage.get(key) if self.storage else None
        if text is None:
            return None
        try:
            return json.loads(text)["result"]
        except (ValueError, KeyError, TypeError):
            self.storage.delete(key)
            return None

    def set(self, key: str, value, **more) -> None:
        if self.storage:
            self.storage.set(key, json.dumps({"result": value} | more, ensure_ascii=False))

    def has(self, key: str) -> bool:
        return bool(self.storage) and self.storage.has(key)

    def delete(self, key: str) -> None:
        if self.storage:
            self.storage.delete(key)

    def clear(self) -> None:
        if self.storage:
            self.storage.clear()

    def child(self, name: str) -> Cache:
        return Cache(self.storage.child(name) if self.storage else None)


def snapshot_rows(df: DataFrame, path: str, column: str | None = None, kind: str = "json") -> None:
    """A file a task of the rows: whole rows as JSON, or one column as text."""
    if kind == "text":
        df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").write.mode("overwrite").text(path)
    else:
        (df.select(column) if column else df).write.mode("overwrite").json(path)


# The columns of the index tables' rows, with their types; the ones before the stroke must be there.
OBJECTS = {
    "entities": "id string, title string | type string, description string, human_readable_id string, text_unit_ids array<string>, community_ids array<string>, degree int",
    "relationships": "id string, source string, target string | description string, human_readable_id string, weight double, text_unit_ids array<string>, combined_degree int",
    "covariates": "id string, subject_id string | type string, human_readable_id string, text_unit_id string, status string",
    "communities": "id string, title string, community string, level string, parent string | children array<string>, entity_ids array<string>, relationship_ids array<string>, text_unit_ids array<string>, size int, period string",
    "community_reports": "id string, title string, community string | summary string, full_content string, human_readable_id string, rank double, size int, period string",
    "text_units": "id string, text string | entity_ids array<string>, relationship_ids array<string>, covariate_ids array<string>, n_tokens int, document_ids array<string>, human_readable_id string",
}


def load_objects(df: DataFrame, kind: str, names: dict[str, str] = {}) -> DataFrame:
    """An index table with the columns and types of its kind (a key of OBJECTS); names: own column -> column of df. Missing optional columns are NULL, missing needed ones an error."""
    need, more = ([c.split(" ", 1) for c in part.split(", ")] for part in OBJECTS[kind].split(" | "))
    if lost := [n for n, _ in need if names.get(n, n) not in df.columns]:
        raise ValueError(f"{kind} lack {lost}")
    return df.select(*[(F.col(names.get(n, n)) if names.get(n, n) in df.columns else F.lit(None)).cast(t).alias(n) for n, t in need + more])


def font_inventory(spans: DataFrame) -> DataFrame:
    """font, size, words, sample from spans(ord, font, size, text), most words first."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return spans.groupBy("font", "size").agg(F.sum(words).alias("words"), F.min_by("text", "ord").alias("sample")).orderBy(F.desc("words"), "font", "size")


def body_spans(spans: DataFrame, fonts: list[str], least: float, most: float, pages: tuple[int, int] | None = None, drop: str | None = None) -> DataFrame:
    """page, text of spans(ord, page, font, size, text) set in one of the body fonts (by prefix) and sizes, within the pages, whose text doesn't match `drop`; a page's spans in order with blanks between."""
    font = F.lit(False)
    for f in fonts:
        font = font | F.col("font").startswith(f)
    kept = spans.filter(font & F.col("size").between(least, most) & (F.trim("text") != ""))
    if pages:
        kept = kept.filter(F.col("page").between(*pages))
    if drop:
        kept = kept.filter(~F.col("text").rlike(drop))
    return kept.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.trim(x["text"])), " ").alias("text"))


def trainer_log(df: DataFrame) -> DataFrame:
    """epoch, loss, eval_loss, eval_accuracy of each entry of log_history."""
    return df.select(F.explode("log_history").alias("e")).select("e.epoch", "e.loss", "e.eval_loss", "e.eval_accuracy")

"""From a folder to a published package: scan, read, deduplicate, mask, chunk, pack, gate.

Every step is a lazily evaluated table; texts are staged once, as three
branches read them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import text as tx
from ..operators import chunking, health, packing, publish, similarity, snapshot
from ..operators.ordering import numbered
from ..sources import files
from . import extraction
from .progress import Progress
from .publication import Store
from .staging import staged


@dataclass(frozen=True)
class Options:
    """Settings of a run; :meth:`legacy` turns the later features off."""

    root: str
    out: str
    chunk_mode: str = "sections"
    chunk_chars: int = chunking.CHUNK_CHARS
    overlap: float = chunking.OVERLAP
    summary: str = "headings"
    excerpt_chars: int = tx.EXCERPT
    sensitive: str = "mask"  # off, warn, mask or block
    dictionary: tuple[str, ...] = ()
    dedupe: str = "exclude"  # off, warn or exclude
    threshold: float = similarity.THRESHOLD
    rule: str = "sequential"  # how parts are filled: sequential or bestfit
    measure: str = "chars"  # chars or tokens
    part_capacity: int | None = None
    max_parts: int = packing.MAX_PARTS
    split_by_folder: bool = False
    priority: tuple[str, ...] = ()
    newest_first: bool = False
    force: bool = False
    least_ratio: float = publish.LEAST_RATIO
    cache: str | None = None  # a folder that keeps extracted texts between runs
    extra: dict[str, str] = field(default_factory=dict)

    def legacy(self) -> Options:
        return replace(self, chunk_mode="lines", summary="plain", excerpt_chars=1 << 30, sensitive="off", dedupe="off", rule="sequential", measure="chars", split_by_folder=False, priority=(), newest_first=False)

    @property
    def capacity(self) -> int:
        return self.part_capacity or (packing.PART_CHARS if self.measure == "chars" else packing.PART_TOKENS)


@dataclass(frozen=True)
class Profile:
    """What a target service takes: size of a part and number of parts."""

    name: str
    part_chars: int = packing.PART_CHARS
    max_parts: int = packing.MAX_PARTS


@dataclass
class Package:
    """The tables of a run."""

    scanned: DataFrame
    outcomes: DataFrame
    groups: DataFrame
    findings: DataFrame
    chunks: DataFrame
    parts: DataFrame


def deduplicated(texts: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(texts with ``keep``, groups): of each group of similar texts the latest is kept, by the unmasked text."""
    if options.dedupe == "off":
        return texts.withColumn("keep", F.lit(True)), texts.select("relative_path", F.lit("").alias("grp")).limit(0)
    groups = staged(similarity.similar_groups(similarity.signatures(texts, "relative_path"), options.threshold, "relative_path"))
    ranked = similarity.keep_latest(texts.join(groups, "relative_path"), "grp", "modified", "relative_path").select("relative_path", "grp", "keep")
    keep = F.coalesce(F.col("keep"), F.lit(True)) if options.dedupe == "exclude" else F.lit(True)
    return texts.join(ranked.drop("grp"), "relative_path", "left").withColumn("keep", keep), ranked


def records(texts: DataFrame, options: Options) -> DataFrame:
    """Chunk records of texts (relative_path, extension, size, status, text, nth), masked or blocked as asked for."""
    body = tx.normalize_text(F.col("text"))
    rows = texts.withColumn("text", pii.mask(body, options.dictionary) if options.sensitive == "mask" else body)
    #: a blocked document's summary must not show what its chunks may not
    shown = pii.mask(F.col("text"), options.dictionary) if options.sensitive == "block" else F.col("text")
    summary = tx.heading_summary(shown) if options.summary == "headings" else tx.plain_summary(shown)
    rows = rows.withColumn("summary", summary)
    chunks = chunking.chunk(rows, options.chunk_mode, options.chunk_chars, options.overlap, "relative_path")
    if options.sensitive == "block":
        chunks = chunking.unblocked(chunks, options.dictionary)
    joined = staged(chunks.join(rows.drop("text"), "relative_path"))
    index = numbered(joined.select("relative_path", "chunk_index", "nth"), [F.col("nth"), F.col("chunk_index")], "index").drop("nth")
    out = joined.join(index, ["relative_path", "chunk_index"]).select(
        "index", "chunk_index", "chunk_count", tx.base_name(F.col("relative_path")).alias("file_name"), "relative_path", "extension",
        F.col("size").alias("size_bytes"), tx.format_size(F.col("size")).alias("size_text"), "summary", F.length("text").alias("text_length"), tx.excerpt(F.col("text"), options.excerpt_chars).alias("text_excerpt"),
        "text", tx.token_estimate(F.col("text")).alias("token_estimate"), F.col("status").alias("extract_status"),
    )
    return out


def packed(chunks: DataFrame, options: Options) -> DataFrame:
    """Chunk records with ``grp`` and ``part``; null part: left over."""
    size = F.length(tx.strip(F.col("text"))) + 2
    group = tx.group_key(F.col("relative_path")) if options.split_by_folder else F.lit("")
    sized = chunks.select("index", group.alias("grp"), (size if options.measure == "chars" else tx.token_estimate(F.col("text"))).alias("size"))
    placed = packing.pack(sized, options.rule, options.capacity, options.max_parts, "grp", "index", "size")
    return chunks.join(placed, "index")


def build(spark: SparkSession, options: Options, progress: Progress | None = None) -> Package:
    """The tables of a run; ``progress`` is told rows and characters of each stage by the jobs that compute them."""
    progress = progress or Progress()
    scanned = files.scan(files.listed(spark, options.root), options.root)
    read = extraction.extracted(scanned, options.root, options.cache, progress) if options.cache else files.extracted(scanned)
    read = staged(progress.watch("extract", read, ok=F.count_if(F.col("status") == "ok"), chars=F.coalesce(F.sum(F.length("text")), F.lit(0))))
    progress.done("extract")
    texts, groups = deduplicated(read, options)
    ordered = files.order_files(texts, options.priority, options.newest_first)
    readable = ordered.where(F.col("keep"))
    found = pii.scan(tx.normalize_text(F.col("text")), options.dictionary) if options.sensitive != "off" else F.create_map().cast("map<string,bigint>")
    findings = pii.merge_findings(readable.select(found.alias("findings")))
    chunks = staged(progress.watch("chunk", records(readable, options), chars=F.coalesce(F.sum("text_length"), F.lit(0))))
    progress.done("chunk")
    outcomes = ordered.select(
        "relative_path", "extension", "size", F.when(F.col("keep"), F.col("status")).otherwise("dedupe_excluded").alias("status"), "reason", "units_total", "units_ok", "failures",
        F.when(F.col("keep"), F.col("modified")).alias("modified"), F.length(tx.normalize_text(F.col("text"))).alias("text_length"), tx.token_estimate(tx.normalize_text(F.col("text"))).alias("token_estimate"),
    )
    return Package(scanned, outcomes, groups, findings, chunks, packed(chunks, options))


def part_texts(parts: DataFrame) -> DataFrame:
    """(grp, part, text) of the parts, their sections in order; a part is bounded by its capacity."""
    section = F.concat(F.lit("## "), F.col("relative_path"), F.lit(" ("), F.col("chunk_index"), F.lit("/"), F.col("chunk_count"), F.lit(")\n"), F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", section.alias("s")))), lambda x: x["s"]), "\n\n")
    return parts.where("part is not null").groupBy("grp", "part").agg(joined.alias("text"), F.count("*").alias("n_chunks"), F.count_distinct("relative_path").alias("n_files"))


def index_rows(package: Package) -> DataFrame:
    """(section, name, note) of an index: files with summaries, excluded files, chunks left over."""
    kept = package.parts.where("part is not null and chunk_index = 1").select(F.lit("file").alias("section"), F.col("relative_path").alias("name"), tx.one_line(F.col("summary")).alias("note"))
    out = package.outcomes.where("status = 'dedupe_excluded'").select(F.lit("excluded").alias("section"), F.col("relative_path").alias("name"), F.lit("duplicate").alias("note"))
    over = package.parts.where("part is null").select(F.lit("overflow").alias("section"), F.col("relative_path").alias("name"), F.col("chunk_index").cast("string").alias("note"))
    return kept.unionByName(out).unionByName(over)


def report(package: Package, today) -> DataFrame:
    """The health score of a run."""
    one = package.groups.groupBy("grp").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    over, hits = package.parts.where("part is null").count(), package.findings.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    return health.health_score(package.outcomes, today, F.lit(one), F.lit(over), F.lit(hits))


def published(spark: SparkSession, out: str) -> str | None:
    """The folder of the package that readers see; None before the first."""
    return Store(spark, out).current()


def publish_package(spark: SparkSession, package: Package, options: Options, stopped: bool = False) -> dict:
    """Judge, write a new version and point readers to it: at any moment they see one whole package.

    A held package leaves the published one as it is and only writes a notice.
    Folders that crashed runs left behind and versions past the last few go.
    """
    store = Store(spark, options.out)
    now, notice = store.current(), f"{options.out}/hold_notice"
    new = package.chunks.count()
    previous = spark.read.parquet(f"{now}/index").count() if now else None
    had_source = not package.outcomes.isEmpty()
    row = publish.decide(spark.range(1), F.lit(options.force), F.lit(stopped), F.lit(had_source), F.lit(previous).cast("long"), F.lit(new), options.least_ratio).first()
    told = {"publish": row["publish"], "reason": row["reason"], "previous": previous, "new": new}
    if not row["publish"]:
        spark.range(1).select(F.lit(row["reason"]).alias("reason"), F.lit(previous).cast("long").alias("previous"), F.lit(new).alias("new")).write.mode("overwrite").json(notice)
        return told
    texts = staged(part_texts(package.parts))
    hashes = texts.select(F.concat_ws("_", "grp", F.lpad(F.col("part").cast("string"), 3, "0")).alias("file_name"), tx.content_hash(F.col("text")).alias("sha"))
    before = spark.read.parquet(f"{now}/state") if now else hashes.limit(0)

    def write(folder: str) -> None:
        texts.write.json(f"{folder}/parts")
        package.chunks.write.json(f"{folder}/chunks")
        package.parts.where("part is not null").select("index", "relative_path", "chunk_index", "grp", "part").write.parquet(f"{folder}/index")
        snapshot.upload_note(before, hashes).write.json(f"{folder}/upload_note")
        hashes.write.parquet(f"{folder}/state")

    told["folder"] = store.publish(write)
    store.clean()
    store.fs.delete(store._path(notice), True)
    return told


def dry_run(package: Package) -> DataFrame:
    """Totals without any output."""
    return package.chunks.agg(F.count_distinct("relative_path").alias("n_files"), F.count("*").alias("n_chunks"), F.sum("text_length").alias("chars"), F.sum("token_estimate").alias("tokens"))


def read_profiles(spark: SparkSession, path: str) -> list[Profile]:
    """Profiles from JSON files, one object each; a handful."""
    rows = spark.read.option("multiLine", True).schema("name string, target_chars_per_file int, max_body_files int").json(path).collect()
    return [Profile(r["name"], r["target_chars_per_file"] or packing.PART_CHARS, r["max_body_files"] or packing.MAX_PARTS) for r in rows if r["name"]]


def profile_package(chunks: DataFrame, profile: Profile) -> DataFrame:
    """Chunk records packed for a profile, one group."""
    sized = chunks.select("index", F.lit("").alias("grp"), (F.length(tx.strip(F.col("text"))) + 2).alias("size"))
    return chunks.join(packing.pack(sized, "sequential", profile.part_chars, profile.max_parts, "grp", "index", "size"), "index")

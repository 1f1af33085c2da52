"""Operator 8: secrets, told apart by who owns them, in DataFrame functions only.

Patterns find spans with known forms, and opaque tokens - long, with letters and digits - are candidates besides. The
method asks the whole corpus who uses the value of each candidate: hashes of values are aggregated by distinct
repositories and owners. A value of many owners or repositories is a copied example; one that few have is live-looking.
Every span of a known form is listed with its class, and live-looking opaque spans are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._session import written

#: Patterns of the query (fixed values): kind, pattern, least length, group whose length counts.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
)
#: Quick tests that hold wherever the pattern has a match that counts.
_QUICK = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
#: Opaque tokens: letters and digits mixed, this long at least. It begins where a token begins, so it is tried once a token.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}"
#: A value is live-looking if at most so many owners and repositories have it, else a copied example.
OWNERS, REPOS = 2, 4


def _spans(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """Matches with places: what lies between matches and the matches themselves, summed up by length in one pass.

    Failing matches are passed over but keep their place in the sum.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(a: Column, z: Column) -> Column:
        start = a["pos"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["whole"]), F.lit(0))
        row = F.struct(start.alias("start"), F.lit(_RANK.get(kind, len(KINDS))).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), z["value"].alias("value"))
        rows = F.when(z["whole"].isNotNull() & (F.length(z["value"]) >= least), F.concat(a["rows"], F.array(row))).otherwise(a["rows"])
        return F.struct(end.alias("pos"), rows.alias("rows"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), F.array().cast(_TYPE).alias("rows")), step, lambda a: a["rows"])


_RANK = {kind: i for i, (kind, *_) in enumerate(KINDS)}
_TYPE = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """doc_id, row (hash of the text), owner, repo, base and opaque spans of every row; only rows that pass a quick test
    are taken apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), (owner if owner is not None else F.lit(None)).cast("string").alias("owner"), (repo if repo is not None else F.lit(None)).cast("string").alias("repo"), text.alias("text"))
    none = F.array().cast(_TYPE)
    base = F.concat(*(F.when(F.col("text").rlike(_QUICK[k]), _spans(F.col("text"), k, p, n, g)).otherwise(none) for k, p, n, g in KINDS))
    opaque = F.when(F.col("text").rlike(OPAQUE), _spans(F.col("text"), "opaque", OPAQUE, 20, 0)).otherwise(none)
    return rows.select("doc_id", "row", "owner", "repo", base.alias("base"), opaque.alias("opaque"))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners of each candidate value; candidates has hash, owner, repo. Each (value, owner, repository)
    is summed up before it is shuffled, so a widely copied value costs a row for each of these and task."""
    pairs = candidates.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str = "lang", owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """doc_id, row, base, spans of every row of docs; spans: start, rank, kind, end, value, n_repos, n_owners, live.

    base holds the spans of known forms, spans these and live-looking opaque ones that lie within none of them, by start.
    owner names the column of owners; a repository is an owner's value of repo. Null owners are one owner, and so are null
    repositories of an owner. Null and empty texts have no span; null ids and repeated rows stay, each with its spans; other
    columns are not read; an empty table gives no row.
    """
    found = base_spans(docs, id_col, text_col, F.concat_ws("/", owner, repo), F.col(owner))
    return scan_found(written(found, "secret-spans"), owners, repos)


def scan_found(found: DataFrame, owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """The second half of scan(), from the table of spans."""
    each = found.where((F.size("base") > 0) | (F.size("opaque") > 0)).select("doc_id", "row", "owner", "repo", "base", F.explode(F.concat("base", "opaque")).alias("s"))
    each = each.withColumn("hash", F.sha2(F.col("s.value"), 256))
    told = each.join(ownership(each), "hash").withColumn("live", (F.col("n_owners") <= owners) & (F.col("n_repos") <= repos))
    within = F.exists("base", lambda b: (b["start"] <= F.col("s.start")) & (b["end"] >= F.col("s.end")))
    listed = told.where((F.col("s.kind") != "opaque") | (F.col("live") & ~within))
    span = F.struct("s.start", "s.rank", "s.kind", "s.end", "s.value", "n_repos", "n_owners", "live")
    spans = listed.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_hit")).agg(F.sort_array(F.collect_set(span)).alias("spans"))
    out = found.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_hit")), "left")
    return out.select("doc_id", "row", "base", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, classes (live or copied, in the order of spans), n_live and
    n_copied of every row."""
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k, *_ in KINDS]
    live = F.size(F.filter("spans", lambda s: s["live"]))
    classes = F.array_join(F.transform("spans", lambda s: F.when(s["live"], F.lit("live")).otherwise(F.lit("copied"))), ",")
    return scanned.select(
        "doc_id", *n, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), classes.alias("classes"), live.cast("long").alias("n_live"), (F.size("spans") - live).cast("long").alias("n_copied")
    )


def redact(docs: DataFrame, mark: str = "[secret]", owner: str = "source", repo: str = "lang", keep_copied: bool = False) -> DataFrame:
    """docs with the text of every span replaced by mark and n_chars counted anew where a text changed; no row goes.

    Spans of known forms go whatever their owners, opaque ones if they are live-looking; with keep_copied only
    live-looking spans go. Null and empty texts, texts without a span, null ids and repeated rows stay as they are; an
    empty table stays empty.
    """
    rows = docs.withColumn("_row", F.xxhash64(F.coalesce("text", F.lit(""))))
    hits = scan(docs, owner=owner, repo=repo)
    if keep_copied:
        hits = hits.withColumn("spans", F.filter("spans", lambda s: s["live"]))
    hits = hits.where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("row").alias("_hit"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_hit"])
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hit")), "left")
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["t"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["t"]).alias("t"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    cut = F.aggregate("_spans", start, step, lambda a: F.concat(a["t"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    new = F.when(F.col("_spans").isNotNull(), cut).otherwise(F.col("text"))
    out = out.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, with source as owner and its languages as repositories."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, small_join

# The kinds of candidates in listed order, their patterns, and the shortest match that counts. A pattern with
# a minimum in it finds the same matches as one without and a filter, its runs being maximal; `assign` keeps the filter,
# because a short match still uses up its text.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
LISTED = ["assign", "access", "hex", "live", "shared"]
SHORTEST_VALUE = 6
#: A value of so many owners, or of so many repositories of more than one owner, is a widely copied example.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 5
#: A live-looking value has one owner, so many characters and so many different ones.
LIVE_OWNERS, LIVE_CHARACTERS, LIVE_LENGTH = 1, 8, 16

#: Different characters of an assigned value below LIVE_LENGTH that is masked.
SHORT_CHARACTERS = 5


def random_looking(value: Column, least: int = LIVE_LENGTH, different: int = LIVE_CHARACTERS) -> Column:
    return (F.length(value) >= least) & (F.size(F.array_distinct(F.split(value, ""))) >= different) & value.rlike("[0-9]")


def _match(kind: str, at: Column, gap: Column, match: Column) -> Column:
    """What is kept of a match: places, sizes and a hash of its value, but not the value, which is not to lie about in written tables."""
    value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
    short = random_looking(value, SHORTEST_VALUE, SHORT_CHARACTERS) & value.rlike("[A-Za-z]") if kind == "assign" else F.lit(False)
    return F.struct(F.lit(kind).alias("kind"), at.alias("at"), gap.alias("gap"), F.length(match).alias("size"), F.length(value).alias("value_size"), F.sha2(value, 256).alias("hash"), random_looking(value).alias("looks"), short.alias("short"))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """An array of _match(): each match with its number and the number of characters between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(found, lambda m, i: _match(kind, i, F.length(F.get(gaps, i)), m))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:string,at:int,gap:int,size:int,value_size:int,hash:string,looks:boolean,short:boolean>>"))


def candidates(docs: DataFrame) -> DataFrame:
    """row, owner, repository, kind, start, stop, value_size, hash, looks, short: candidates with code point offsets.

    `docs` holds row, owner, repository and matches. Offsets are running sums over a row's matches of one kind.
    """
    one = docs.select("row", "owner", "repository", F.explode("matches").alias("m")).select("row", "owner", "repository", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(before).cast("long")
    one = one.withColumn("stop", stop).where(F.col("value_size") >= SHORTEST_VALUE)
    return one.select("row", "owner", "repository", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop", "value_size", "hash", "looks", "short")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories, occurrences of each candidate value. Copies within one repository collapse before the shuffle."""
    each = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"))


def widely_copied() -> Column:
    return (F.col("owners") >= SHARED_OWNERS) | (F.col("owners") > LIVE_OWNERS) & (F.col("repositories") >= SHARED_REPOSITORIES)


def to_mask() -> Column:
    """Of a span: not widely copied, and a random-looking value, or a shorter assigned one with letters too."""
    return ~widely_copied() & (F.col("looks") | F.col("short"))


def scan(docs: DataFrame, *, text_col: str = "text", owner: Column | None = None, repository: Column | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has the columns of docs but the text (or `keep`, of which the first numbers the rows), and `row`; spans has row, kind, start, stop, value_size, looks, short, owners, repositories, occurrences, verdict.

    An owner is the document's source and a repository a source and language unless given; null owners count as one. The
    verdict is `shared` for values of at least SHARED_OWNERS owners or, if they have more than one, of SHARED_REPOSITORIES
    repositories, `live` for values of one owner that look random (LIVE_LENGTH characters, LIVE_CHARACTERS different ones,
    with a digit), else `unsure`. Null texts hold nothing; an empty table gives empty tables. No value is written. The
    text is read once and not shuffled; what is shuffled is candidates.
    """
    owner = F.coalesce(owner if owner is not None else F.col("source"), F.lit(""))
    repository = F.coalesce(repository if repository is not None else F.concat_ws("/", "source", "lang"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    matches = F.concat(*[_matches(text, kind, pattern) for kind, pattern in PATTERNS.items()])
    rest = keep if keep is not None else [c for c in docs.columns if c != text_col]
    read = docs.select(F.monotonically_increasing_id().alias("row") if keep is None else F.col(keep[0]).alias("row"), owner.alias("owner"), repository.alias("repository"), F.struct(*rest).alias("doc"), matches.alias("matches"))
    read = materialize(read, "scanned")
    found = materialize(candidates(read), "candidates")
    frequency = materialize(ownership(found), "ownership")
    verdict = F.when(widely_copied(), "shared").when((F.col("owners") <= LIVE_OWNERS) & F.col("looks"), "live").otherwise("unsure")
    spans = found.join(frequency.hint("merge"), "hash").select("row", "kind", "start", "stop", "value_size", "looks", "short", "owners", "repositories", "occurrences", verdict.alias("verdict"))
    return read.select("row", "doc.*"), spans


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, LISTED)), s["listed"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, most_owners, most_repositories: one row per document.

    The last two are of the document's most widely owned and most widely held candidates, 0 without any. To the base spans the method adds, for each value that it finds live or shared, a span of that kind over the value.
    """
    rows, spans = scan(docs, **options)
    listed = F.array_position(F.array(*map(F.lit, LISTED)), F.col("kind")).cast("int")
    own = F.struct(F.col("start").alias("start"), listed.alias("listed"), F.col("stop").alias("stop"))
    more = F.struct((F.col("stop") - F.col("value_size")).cast("long").alias("start"), F.when(F.col("verdict") == "live", 4).otherwise(5).alias("listed"), F.col("stop").alias("stop"))
    each = spans.select("row", "owners", "repositories", F.explode(F.when(F.col("verdict") == "unsure", F.array(own)).otherwise(F.array(own, more))).alias("s"))
    grouped = materialize(each.groupBy("row").agg(F.array_sort(F.array_distinct(F.collect_list("s"))).alias("s"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories")), "spans")
    out = rows.select("row", "doc_id").join(grouped.hint("merge"), "row", "left").withColumn("s", F.coalesce("s", F.array().cast(grouped.schema["s"].dataType)))
    count = lambda k: F.size(F.filter("s", lambda x: x["listed"] == k)).cast("long")
    base = F.filter("s", lambda x: x["listed"] <= 3)
    return out.select("doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"), count(4).alias("n_live"), count(5).alias("n_shared"), F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"), F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"))


def mask_live(docs: DataFrame, *, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with each value of to_mask() replaced by `mask` and n_chars brought up to date; shared and plain values stay, and so does every row.

    More is masked than the report calls live: values of two owners, and assigned ones too short for that verdict.

    Overlapping values are masked as one. The edits of a row travel to it by its row number; texts without edits are
    untouched.
    """
    columns = docs.columns
    if taken := {"__row", "__edits"} & set(columns):
        raise ValueError(f"columns of docs are called {sorted(taken)}")
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    _, spans = scan(numbered, text_col=text_col, keep=["__row"])
    live = spans.where(to_mask()).select(F.col("row").alias("__row"), (F.col("stop") - F.col("value_size")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    edits = materialize(live.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__edits")), "edits")
    joined = small_join(numbered, edits, "__row")
    text = F.col(text_col)
    done = F.aggregate(
        "__edits",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, e: F.when(e["stop"] <= a["at"], a).otherwise(F.struct(F.concat(a["out"], F.when(e["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, e["start"] - a["at"]), F.lit(mask))).otherwise("")).alias("out"), e["stop"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    changed = F.when(F.col("__edits").isNull(), text).otherwise(done)
    out = joined.withColumn(text_col, changed)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__edits").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns)

"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each kind of secret is one regular expression. Splitting a text at its matches and extracting the matches gives,
together, every match's place: lengths are running sums of pieces and matches, in code points, summed in blocks of
about the root of their number. Each candidate value's hash is then counted over the whole corpus by distinct
repositories and owners: a value that many owners hold is a copied example, one that few hold looks live. Values
are counted by (hash, owner, repository), then (hash, owner), then hash, all with partial aggregates, so a value
copied into a third of all rows is combined before it is shuffled.

Time grows with a text's length whatever it holds: a literal tells first whether a kind can occur; a pattern either
begins at the border of a run or gives up after a bounded number of characters of one that it doesn't match.

Defined results: a null or empty text has no spans; a null owner or repository counts as one of its own; repeated
rows are reported one by one and count once in frequencies; an empty table gives an empty result; columns other
than the id, the text and the owner are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import ROW, Stage, read

#: A value that at least this many owners hold is a widely copied example.
EXAMPLE_OWNERS = 3

_KEY = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
#: Kinds in the order in which equal starts are listed: (kind, pattern, group of the value, least length of the value,
#: gate). Where a shorter match can't hide a longer one the least length is in the pattern too, and short runs cost
#: nothing. A text that holds no literal of the gate (none given: any text) has no match.
BASE = (
    ("assign", _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, (":", "=")),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, ("AKIA",)),
    ("hex", r"[0-9a-f]{32,}", 0, 32, ()),
)
OWN = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}", 0, 24, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    ("slack", r"xox[abposr]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30, (".eyJ",)),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, ("AIza",)),
    ("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24, ("k_live_", "k_test_")),
    ("pem", r"-----BEGIN (?:[A-Z]++ )?PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]{32,})", 1, 32, ("PRIVATE KEY-----",)),
    ("url", r"(?<![a-z0-9+])[a-z][a-z0-9+]*+://[^\s/:@]++:([^\s/:@]{6,}+)@", 1, 6, ("://",)),
)
KINDS = BASE + OWN
SPANS, LIVE, LAST = "__rankforge_spans", "__rankforge_live", "__rankforge_last"
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _with(value: Column, then) -> Column:
    """then(value), the value being worked out once however often it stands in the result."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sums(state: Column, x: Column) -> Column:
    """A step of a running sum: (at, out) and the place after x, out being the places before each."""
    return F.struct((state["at"] + x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))


def _starts(steps: Column) -> Column:
    """The sums of all that stands before each of steps(g, n) and of its own g, in blocks of about the root of their number."""
    none = F.array().cast("array<int>")
    running = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), none.alias("out")), _sums, lambda s: s["out"])
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(steps)))).cast("int")

    def blocks(n: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / n).cast("int")), lambda k: F.slice(steps, k * n + 1, n))
        return _with(cut, within)

    def within(cut: Column) -> Column:
        total = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["g"] + x["n"]))
        before = running(total, F.lit(0))
        # A match begins after its own gap.
        own = F.zip_with(cut, before, lambda b, at: F.zip_with(running(F.transform(b, lambda x: x["g"] + x["n"]), at), b, lambda s, x: s + x["g"]))
        return F.flatten(own)

    return _with(size, blocks)


def _spans(text: Column, rank: int, pattern: str, group: int, least: int, gate: tuple[str, ...]) -> Column:
    """All leftmost non-overlapping matches of a pattern whose value is long enough: (start, rank, end, value)."""
    p = F.lit(pattern)
    empty = F.array().cast(SPAN)

    def found(pieces: Column) -> Column:
        # Before the k-th match stand the first k pieces and k - 1 matches. A pattern finds in a match what it found in the text.
        steps = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.regexp_extract_all(text, p, F.lit(0)), lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("n"), w.alias("w")))
        return F.when(F.size(pieces) > 1, _with(steps, placed)).otherwise(empty)

    def placed(steps: Column) -> Column:
        value = lambda w: F.regexp_extract(w, pattern, group) if group else w
        spans = F.zip_with(steps, _starts(steps), lambda x, at: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + x["n"]).alias("end"), value(x["w"]).alias("value")))
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    matched = _with(F.split(text, pattern, -1), found)
    may = [F.contains(text, F.lit(g)) for g in gate]
    return F.when(reduce(Column.__or__, may), matched).otherwise(empty) if may else matched


def _written(spans: Column) -> Column:
    """kind:start:end by start, then in the order of kinds, joined by commas."""
    names = F.array(*(F.lit(k) for k, *_ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with spans in the column out: every secret's place (start, rank of its kind, end; code points, end exclusive) and value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*(_spans(text, rank, *kind[1:]) for rank, kind in enumerate(KINDS)))))


def ownership(hits: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) over hits(hash, owner, repo); a repository belongs to its owner."""
    each = hits.select("hash", "owner", "repo").distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def judge(stage: Stage, found: DataFrame, owner_col: str, repo_col: str, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(_row, spans with owners, repos and live) for the rows of found(_row, spans, owner, repo) that have spans."""
    hits = found.where(F.size("spans") > 0).select(ROW, F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.explode("spans").alias("span"))
    hits = stage.write(hits.withColumn("hash", F.sha2("span.value", 256)), "hits")
    owned = ownership(hits)
    live = F.col("n_owners") < example_owners
    span = F.struct("span.start", "span.rank", "span.end", "span.value", "n_owners", "n_repos", live.alias("live"))
    return hits.join(owned, "hash").groupBy(ROW).agg(F.array_sort(F.collect_list(span)).alias("judged"))


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """docs without the text, with spans and judged spans, one row for each row of docs."""
    stage = Stage(docs.sparkSession)
    columns = list(dict.fromkeys(["doc_id", owner_col, repo_col]))
    found = find(docs.select(*columns, "text").withColumn(ROW, F.monotonically_increasing_id())).drop("text")
    found = stage.write(found, "found")
    return found.join(judge(stage, found, owner_col, repo_col), ROW, "left")


def redact(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", mark: str = "<secret>") -> DataFrame:
    """docs with the owner-specific, live-looking secrets in their texts replaced by mark; copied examples stay."""
    stage = Stage(docs.sparkSession)
    # Texts are scanned once and kept with their spans; the few that have some are told apart as they are read again.
    found = stage.write(find(docs, out=SPANS).withColumn(ROW, F.monotonically_increasing_id()), "found")
    rows = found.where(F.size(SPANS) > 0)
    judged = judge(stage, rows.select(ROW, F.col(SPANS).alias("spans"), *dict.fromkeys([owner_col, repo_col])), owner_col, repo_col)
    # Before a span goes what stands from the furthest end so far to its start; one that begins inside what is gone adds nothing.
    before = Window.partitionBy(ROW).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    live = judged.select(ROW, F.explode("judged").alias("s")).where("s.live").select(ROW, "s.start", "s.rank", "s.end")
    live = live.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    live = live.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "from"))).alias(LIVE), F.max("end").alias(LAST))

    def cleaned(chars: Column) -> Column:
        part = lambda at, n: F.array_join(F.slice(chars, at + 1, n), "")
        kept = F.transform(LIVE, lambda s: F.when(s["start"] >= s["from"], F.concat(part(s["from"], s["start"] - s["from"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), part(F.col(LAST), F.size(chars)))

    text = F.when(F.size(LIVE) > 0, _with(F.split("text", "", -1), cleaned)).otherwise(F.col("text"))
    out = rows.join(live, ROW, "left").withColumn("text", text).select(*docs.columns)
    return found.where(F.size(SPANS) == 0).select(*docs.columns).union(out)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        F.size(F.filter(F.col("judged"), lambda s: s["live"])).alias(LIVE),
        F.size(F.filter(F.col("judged"), lambda s: ~s["live"])).alias("_examples"),
    ).select("*", F.greatest(LIVE, F.lit(0)).cast("long").alias("n_live"), F.greatest("_examples", F.lit(0)).cast("long").alias("n_examples")).drop(LIVE, "_examples")

"""Secret scans with corpus-wide ownership counts.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import cut, fresh, table

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that no base kind names: long, with digits and letters of both cases.
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ["assign", "access", "hex", "owned"]
MIN_VALUE = 12          # of an assigned value
EXAMPLE_OWNERS = 3      # a value seen with so many owners is a copied example
_RUN = 64


def _places(text: Column, pattern: str, matches: Column) -> Column:
    """Start and end of each match, in code points: lengths of the pieces between matches and of the matches, summed up.

    Sums run over blocks of matches and then inside each, so that a text with very many matches doesn't
    copy an ever longer array.
    """
    pair = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("p"), matches.alias("m"))
    lengths = F.transform(pair, lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _RUN).cast("int")), lambda b: F.slice(lengths, b * _RUN + 1, _RUN))
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + x["n"])
    offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + total(b))))

    def inside(block, offset):
        first = F.struct(offset.alias("at"), F.expr("cast(array() AS array<struct<start:int,stop:int>>)").alias("out"))
        add = lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("stop")))).alias("out"))
        return F.aggregate(block, first, add, lambda a: a["out"])

    nothing = F.expr("cast(array() AS array<struct<start:int,stop:int>>)")
    spans = F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), inside))
    return F.when(F.size(matches) > 0, spans).otherwise(nothing)


def _spans(kind: int, places: str, matches: str, value) -> Column:
    """Spans of a kind with the hash of their value; the value itself goes no further."""
    return F.zip_with(places, matches, lambda p, m: F.struct(
        p["start"].alias("start"), F.lit(kind).alias("kind"), p["stop"].alias("stop"),
        F.length(value(m)).alias("n"), F.xxhash64(value(m)).alias("hash")))


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``base`` and ``tokens``: arrays of (start, kind, stop, n, hash), by start and kind.

    ``base`` holds the matches of the first three kinds, leftmost and non-overlapping in each; ``tokens`` other
    long tokens that overlap none of them.  A null text is empty.
    """
    plain = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    patterns = {"a": ASSIGN, "k": ACCESS, "h": HEX, "t": TOKEN}
    for name, pattern in patterns.items():
        plain = plain.withColumn(f"__{name}", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    for name, pattern in patterns.items():
        plain = plain.withColumn(f"__{name}p", _places(F.col("__text"), pattern, F.col(f"__{name}")))
    whole = lambda m: m
    assign = F.filter(_spans(0, "__ap", "__a", lambda m: F.regexp_extract(m, ASSIGN, 2)), lambda s: s["n"] >= MIN_VALUE)
    plain = plain.withColumn("base", F.array_sort(F.concat(assign, _spans(1, "__kp", "__k", whole), _spans(2, "__hp", "__h", whole))))
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    tokens = F.zip_with("__tp", "__t", lambda p, m: F.struct(
        p["start"].alias("start"), F.lit(3).alias("kind"), p["stop"].alias("stop"), F.when(mixed(m), F.length(m)).otherwise(0).alias("n"), F.xxhash64(m).alias("hash")))
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    plain = plain.withColumn("tokens", F.filter(tokens, lambda t: (t["n"] > 0) & free(t)))
    return plain.drop(f"{text}", "__text", *[f"__{n}" for n in patterns], *[f"__{n}p" for n in patterns])


def ownership(values: DataFrame) -> DataFrame:
    """hash, repositories, owners: with how many distinct ones each value occurs.  ``values``: hash, repository, owner.

    Equal rows meet in partial aggregates before any shuffle, so a value that every document copies is a row per task.
    """
    one = values.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    each = one.groupBy("hash", "owner").agg(F.sum("one").alias("n"))
    return each.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, example_owners: int = EXAMPLE_OWNERS, keep: Column | None = None) -> DataFrame:
    """doc_id and the spans of every row of ``docs``: doc_id, base, owned, n_live, n_example (and the column ``keep``).

    ``owned`` are the tokens that look live: no base kind names them and fewer than ``example_owners`` owners
    hold them; a widely copied token is an example.  Base spans stay whoever holds them; ``n_live`` and
    ``n_example`` tell them apart in the same way.  By default a document's repository is its source, the owner
    what precedes a slash there; a null one is an owner of its own.

    Every row gives a row, repeated ones too; a null or empty text has no spans.
    """
    repository = F.coalesce(F.col("`source`") if repository is None else repository, F.lit(""))
    owner = F.split(repository, "/", 2)[0] if owner is None else F.coalesce(owner, F.lit(""))
    kept = [] if keep is None else [keep]
    named = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"), repository.alias("repository"), owner.alias("owner"), *kept)
    kept = named.columns[4:]
    # the row's number is stored with it, so that later reads agree on it
    found = cut(find_candidates(named).withColumn("rid", F.monotonically_increasing_id()))
    spans = found.select("rid", "repository", "owner", F.explode(F.concat("base", "tokens")).alias("s"))
    counts = ownership(spans.select(F.col("s.hash").alias("hash"), "repository", "owner"))
    judged = spans.select("rid", "s", F.col("s.hash").alias("hash")).join(counts, "hash").withColumn("live", F.col("owners") < example_owners)
    per_row = judged.filter("s.kind < 3 OR live").groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("s.kind") == 3, F.col("s")))).alias("owned"),
        F.sum(F.when((F.col("s.kind") < 3) & F.col("live"), 1).otherwise(0)).alias("n_live"),
        F.sum(F.when((F.col("s.kind") < 3) & ~F.col("live"), 1).otherwise(0)).alias("n_example"))
    none = F.expr("cast(array() AS array<struct<start:int,kind:int,stop:int,n:int,hash:bigint>>)")
    return found.select("rid", "doc_id", "base", *kept).join(per_row, "rid", "left").select(
        "doc_id", *kept, "base", F.coalesce("owned", none).alias("owned"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def _mask_base(text: Column) -> Column:
    """The base matches as ``[kind]``; an assignment keeps its name.

    A text such as ``secret=token:...`` holds an assignment inside one that is too short; it is masked too."""
    name, value = ASSIGN.rsplit("(", 1)
    text = F.regexp_replace(text, f"({name})(?={value.removesuffix('+)')}{{{MIN_VALUE}}}){value.removesuffix(')')}", "$1[assign]")
    return F.regexp_replace(F.regexp_replace(text, ACCESS, "[access]"), HEX, "[hex]")


def _mask_spans(text: Column, spans: Column, label: str) -> Column:
    """Spans that don't overlap, in order, as ``label``."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    add = lambda a, s: F.struct(
        F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(label)).alias("out"), s["stop"].alias("at"))
    return F.aggregate(spans, first, add, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text) - a["at"])))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with masked secrets in ``text`` and all else as it is: base matches, and tokens that ``scan`` finds live.

    Only rows that hold a long token at all meet the scan's result; the others pass without a shuffle.  A null text stays null.
    """
    text = F.col("`text`")
    loud = F.coalesce(text.rlike(TOKEN), F.lit(False))
    some = docs.filter(loud)
    key = F.xxhash64(text)
    named = some.select(F.col("`doc_id`").alias("doc_id"), text.alias("text"), F.col("`source`").alias("source"))
    owned = scan(named, keep=key.alias("text_hash")).filter(F.size("owned") > 0)
    id_, hash_, spans = fresh(docs, "of", "hash", "spans")
    owned = owned.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("owned").alias(spans)).dropDuplicates([id_, hash_])
    met = some.join(owned, F.col("`doc_id`").eqNullSafe(F.col(id_)) & (key == F.col(hash_)), "left")
    masked = F.when(F.col(spans).isNull(), text).otherwise(_mask_spans(text, F.col(spans), "[owned]"))
    met = met.withColumn("text", masked).drop(id_, hash_, spans)
    return met.unionByName(docs.filter(~loud)).withColumn("text", _mask_base(text))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``scan`` over all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", "owned"))).alias("spans"), "n_live", "n_example")

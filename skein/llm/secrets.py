"""Secrets: base patterns, and owner-specific tokens by corpus-wide frequency.

Method: every candidate's hash is aggregated over the whole corpus by distinct repositories
and owners.  A value that several owners or many repositories of one owner share is a widely copied example; one that a single
owner has in a few places is a live-looking credential.  All of it is DataFrame functions: no Python runs
on the executors.

The verdict decides which further spans are added, is shown for base spans too (``live``), and
says what ``redact`` masks.  In the tables here a document's ``source`` is its owner, and its source and
language together are its repository.

One pass over the texts finds matches and the lengths of what lies between them (``split``
and ``regexp_extract_all`` with the same pattern); texts aren't shuffled.  A plain substring test
comes before each costly pattern.  Only rows with
matches go on, as numbers and short strings, where a window turns lengths into offsets in
code points.  Hashes are counted in two steps, (hash, repository, owner) and then hash, so a
hot value is pre-aggregated before each shuffle; verdicts of hot values reach their spans by a broadcast.

Defined cases: a null or empty text has no spans; a null repository or owner counts as
one of its own; repeated rows are scanned alike, and count once; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut

#: Fixed patterns of the base kinds, in their order; (pattern, group that must be long enough, its length).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}+", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
}
#: Candidates that the method decides: long unbroken tokens of letters and digits.
TOKEN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+"
#: A value in more repositories or owners than this is a copied example.
MOST_REPOSITORIES, MOST_OWNERS = 2, 1
KINDS = [*BASE, "token"]
#: A value of more than 1/HOT of all spans gets its verdict by a broadcast.
HOT = 1024
#: What a text must hold, lower-cased or as it is, for a pattern to fit; a cheap test before the pattern.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = "[A-Za-z0-9_+/=-]{20,}+"


def _may(text: Column, kind: str) -> Column:
    """Whether the kind's pattern can fit at all; true wherever it does."""
    if kind == "assign":
        low = F.lower(text)
        return (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & reduce(or_, (F.contains(low, F.lit(w)) for w in _WORDS))
    return F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike("[0-9a-f]{24}") if kind == "hex" else text.rlike(_RUN)


def _fits(text: Column, kind: str) -> Column:
    return _may(text, kind) & text.rlike(BASE[kind][0] if kind in BASE else TOKEN)


def _matches(text: Column, kind: str) -> Column:
    """Structs (kind, gap before, length, value, length of the tested group) of all matches."""
    pattern, group, _ = BASE.get(kind, (TOKEN, 0, 0))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("w"), tested.alias("t"), F.slice(gaps, 1, F.size(gaps) - 1).alias("g"))
    made = F.transform(zipped, lambda m: F.struct(F.lit(kind).alias("kind"), F.length(m["g"]).alias("gap"), F.length(m["w"]).alias("length"), m["t"].alias("value")))
    empty = F.array().cast("array<struct<kind:string,gap:int,length:int,value:string>>")
    return F.when(_fits(text, kind), made).otherwise(empty)


def _named(columns: tuple[str, ...]) -> Column:
    """One text for several columns; nulls are told from texts."""
    return F.to_json(F.array(*(F.col(c).cast("string") for c in columns))) if len(columns) > 1 else F.col(columns[0]).cast("string")


def scan(docs: DataFrame, repository: tuple[str, ...], owner: tuple[str, ...], *extra: Column | str) -> tuple[DataFrame, DataFrame]:
    """Rows with a number each and the ``extra`` columns, and the spans found in them ``(row, repository, owner, kind, start, end, value)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*(_matches(text, k) for k in KINDS)).alias("found")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), *extra, _named(repository).alias("repository"), _named(owner).alias("owner"), found))
    each = rows.where(F.size("found") > 0).select("row", "repository", "owner", F.posexplode("found").alias("n", "m")).select("row", "repository", "owner", "n", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.col("length")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    least = F.lit(0)
    for kind, (_, _, n) in BASE.items():
        least = F.when(F.col("kind") == kind, n).otherwise(least)
    return rows, spans.where(F.length("value") >= least).select("row", "repository", "owner", "kind", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """Per hash of a value: how many distinct repositories and owners have it."""
    one = spans.select(F.xxhash64("value").alias("h"), F.sha2("value", 256).alias("hash"), F.coalesce("repository", F.lit("\0")).alias("r"), F.coalesce("owner", F.lit("\0")).alias("o"))
    pairs = one.groupBy("hash", "r", "o").agg(F.count(F.lit(1)).alias("n"))
    by_owner = pairs.groupBy("hash", "o").agg(F.count(F.lit(1)).alias("rs"), F.sum("n").alias("n"))
    by_repository = pairs.groupBy("hash", "r").agg(F.count(F.lit(1)).alias("os"))
    return (
        by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n"))
        .join(by_repository.groupBy("hash").agg(F.count(F.lit(1)).alias("repositories")), "hash")
    )


def judged(spans: DataFrame, most_repositories: int = MOST_REPOSITORIES, most_owners: int = MOST_OWNERS) -> DataFrame:
    """``spans`` with ``hash`` and ``live``: false where the value is a widely copied example.

    A value of more than 1/``HOT`` of all spans may be joined by a broadcast, as there are fewer than
    ``HOT`` of them; all others are joined by a shuffle that no value can fill.
    """
    found = ownership(spans).withColumn("live", (F.col("repositories") <= most_repositories) & (F.col("owners") <= most_owners))
    counted = cut(found.select("hash", "n", "live"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > total
    placed = spans.withColumn("hash", F.sha2("value", 256)).join(F.broadcast(counted.where(is_hot).select("hash", F.col("live").alias("hot"))), "hash", "left")
    rest = placed.where("hot is null").join(counted.where(~is_hot).select("hash", "live"), "hash").drop("hot")
    return placed.where("hot is not null").withColumnRenamed("hot", "live").unionByName(rest)


def _assembled(spans: DataFrame) -> DataFrame:
    """Per row: counts, and the texts of base spans, of all spans and of live ones, in order of start, then kind."""
    number = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        number = F.when(F.col("kind") == k, i).otherwise(number)
    base = F.col("kind") != "token"
    item = F.struct("start", number.alias("k"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda x: x["s"]), ",")
    return spans.groupBy("row").agg(
        *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in BASE),
        joined(base).alias("base"), joined(F.lit(True)).alias("spans"), joined(F.col("live")).alias("live"),
    )


def added(spans: DataFrame) -> DataFrame:
    """Base spans, and live tokens that overlap none of them."""
    base = spans.where(F.col("kind") != "token")
    tokens = spans.where((F.col("kind") == "token") & F.col("live"))
    taken = base.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    free = tokens.join(taken, "row", "left").where(~F.coalesce(F.exists("taken", lambda t: (t["start"] < F.col("end")) & (F.col("start") < t["end"])), F.lit(False))).drop("taken")
    return base.unionByName(free)


def find(docs: DataFrame, repository: tuple[str, ...] = ("source", "lang"), owner: tuple[str, ...] = ("source",)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, their digest, all spans, and those whose value is live-looking."""
    rows, spans = scan(docs, repository, owner, "doc_id")
    per_row = _assembled(added(cut(judged(spans))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *(zero(f"n_{k}") for k in BASE), F.sha2(blank("base"), 256).alias("base_sha256"), blank("spans").alias("spans"), blank("live").alias("live"),
    )


def redact(docs: DataFrame, mask: str = "<secret>", repository: tuple[str, ...] = ("source", "lang"), owner: tuple[str, ...] = ("source",)) -> DataFrame:
    """``docs`` with live-looking values replaced by ``mask``; copied examples and all other text stay.

    ``n_chars``, where ``docs`` has it, follows the new text.  The one pass of the patterns keeps the
    rows that have matches, with their texts; all other rows pass without a shuffle after the cheap
    tests that ``_may`` makes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = reduce(or_, (_may(text, k) for k in KINDS))
    rows, spans = scan(docs.where(some), repository, owner, F.struct(*docs.columns).alias("doc"))
    spans = judged(spans).where("live").select("row", (F.col("end") - F.length("value")).alias("start"), "end")
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    body = F.col("doc.text").cast("string")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"])
    kept = F.transform("cuts", lambda c, i: F.substring(body, (before(i) + 1).cast("int"), (c["start"] - before(i)).cast("int")))
    tail = F.substring(body, (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length(body))
    text = F.when(F.col("cuts").isNull(), body).otherwise(F.concat(F.array_join(kept, mask), F.lit(mask), tail))
    new = rows.where(F.size("found") > 0).select("row", "doc").join(lists, "row", "left").withColumn("new", text)
    fields = {c: F.col(f"doc.`{c}`").alias(c) for c in docs.columns} | {"text": F.col("new").alias("text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("cuts").isNull(), F.col("doc.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    quiet = rows.where(F.size("found") == 0).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
    return docs.where(~some).unionByName(quiet).unionByName(new.select(*fields.values()))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``find`` over ``documents``: matches and the texts between them, then the same counts and verdicts."""
    each = []
    for number, kind in enumerate(KINDS):
        # without look-around: a token is a longest run of its characters that has a digit and a letter
        pattern, group, least = BASE.get(kind, ("[A-Za-z0-9_+/=-]{20,}", 0, 0))
        pattern = pattern.replace("'", "''").replace("}+", "}")
        each.append(
            f"select r, repository, owner, {number} as k, '{kind}' as kind, unnest(regexp_extract_all(t, '{pattern}', 0)) as w, unnest(regexp_extract_all(t, '{pattern}', {group})) as value, "
            f"unnest(list_transform(string_split_regex(t, '{pattern}')[:-2], lambda g: length(g))) as gap, generate_subscripts(regexp_extract_all(t, '{pattern}', 0), 1) as n, {least} as least from d where regexp_matches(t, '{pattern}')"
        )
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
    joined = lambda name, cond: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, k) filter ({cond}), '') as {name}"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as owner, coalesce(source, chr(0)) || chr(1) || coalesce(lang, chr(0)) as repository from documents),
m as ({" union all ".join(each)}),
placed as (select *, sum(gap + length(w)) over (partition by r, k order by n) as b from m),
spans as (select r, repository, owner, k, kind, value, (b - length(w))::bigint as a, b::bigint as b from placed
  where length(value) >= least and (kind <> 'token' or (regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Za-z]')))),
owned as (select value, count(distinct repository) <= {MOST_REPOSITORIES} and count(distinct owner) <= {MOST_OWNERS} as live from spans group by value),
judged as (select spans.*, live from spans join owned using (value)),
kept as (select * from judged j where kind <> 'token' or (live and not exists (select 1 from judged o where o.r = j.r and o.kind <> 'token' and o.a < j.b and j.a < o.b))),
told as (select r, {counts}, {joined('base', "kind <> 'token'")}, {joined('spans', 'true')}, {joined('live', 'live')} from kept group by r)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(live, '') as live from d left join told using (r)"""

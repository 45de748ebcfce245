"""Personal data: fixed forms, and further identifiers found by patterns of words that the fixed forms teach. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import written
from talktable.storage import materialize

#: kinds in the order in which spans of the same start are listed
KINDS = ("email", "ip", "card", "phone")
# The forms of the kinds. Possessive repeats and looks behind keep the search linear in the text: a match that could
# begin further left would have begun there.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a form to occur.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]",
}
# Looser forms of identifiers that only count in the right words, and the kinds they can be.
LOOSE = {
    "address": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++|\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)*+",
        r"@|[(\[]at[)\]]", ("email",),
    ),
    "host": (
        r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}+(?![0-9])",
        r"[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9]\[\.\][0-9]", ("ip",),
    ),
    "number": (
        r"(?<![0-9A-Za-z])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9])++", r"[0-9](?:[\x20().-]{0,2}[0-9]){6}", ("card", "phone"),
    ),
}
DIGITS = {"card": (12, 19), "phone": (7, 15)}
#: characters before an identifier of which its pattern is made
TAIL = 96
#: matches whose places are summed at a time
CHUNK = 128


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each place of an array, in two levels so that no long array grows item by item."""
    zero = F.lit(0).cast("long")

    def before(values: Column, first: Column) -> Column:
        grown = F.aggregate(values, F.array(first), lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))
        return F.slice(grown, F.lit(1), F.size(values))

    count = F.ceil(F.size(lengths) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), count), lambda c: F.slice(lengths, (c - 1) * CHUNK + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda n, v: n + v))
    starts = before(totals, zero)
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(chunks, starts, before))).otherwise(F.array().cast("array<long>"))


def _matches(docs: DataFrame, forms: dict[str, tuple[str, str]]) -> DataFrame:
    """``docs`` with, for each name, the array of its matches (start, end, value, tail) in ``_text``, left to right, not overlapping.

    ``tail`` is what stands before, at most ``TAIL`` characters and from the end of the match before. Places are in code points.
    """
    text = F.col("_text")
    for name, (form, needed) in forms.items():
        has = F.rlike(text, F.lit(needed))
        docs = docs.withColumns({
            f"_{name}_values": F.when(has, F.regexp_extract_all(text, F.lit(form), F.lit(0))).otherwise(F.array().cast("array<string>")),
            f"_{name}_gaps": F.when(has, F.split(text, form, -1)).otherwise(F.array().cast("array<string>")),
        })
    for name in forms:
        values = F.col(f"_{name}_values")
        gaps = F.slice(F.col(f"_{name}_gaps"), F.lit(1), F.size(values))
        lengths = F.zip_with(gaps, values, lambda g, v: (F.length(g) + F.length(v)).cast("long"))
        docs = docs.withColumn(f"_{name}_lengths", lengths)
    # an array that a lambda reads has to be a column: an expression would be worked out for each item
    for name in forms:
        docs = docs.withColumn(f"_{name}_before", _running(F.col(f"_{name}_lengths")))
    for name in forms:
        pairs = F.arrays_zip(
            F.col(f"_{name}_values").alias("value"), F.slice(F.col(f"_{name}_gaps"), F.lit(1), F.size(f"_{name}_values")).alias("gap"),
            F.col(f"_{name}_before").alias("before"),
        )
        docs = docs.withColumn(f"_{name}", F.transform(pairs, lambda p: F.struct(
            (p["before"] + F.length(p["gap"])).alias("start"), (p["before"] + F.length(p["gap"]) + F.length(p["value"])).alias("end"),
            p["value"].alias("value"), F.right(p["gap"], F.lit(TAIL)).alias("tail"), (F.length(p["gap"]) > TAIL).alias("cut"),
        ))).drop(f"_{name}_values", f"_{name}_gaps", f"_{name}_lengths", f"_{name}_before")
    return docs


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the form of ``kind`` is one."""
    if kind == "ip":
        return F.rlike(value, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"))
    size = F.length(_digits(value))
    if kind == "card":
        return size.between(14, 19) & F.call_function("luhn_check", _digits(value))
    return size.between(10, 15) if kind == "phone" else F.lit(True)


def words_of(text: Column) -> Column:
    """Words by which patterns are told apart: lower case, letters and digits."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _pattern(*words: Column) -> Column:
    """Key of a pattern: the words before the place of an identifier."""
    return F.xxhash64(F.lit(len(words)), *words)


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _key, base, loose) of each row: its valid spans of the fixed forms, and the matches of the looser ones."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_key"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
    )
    forms = {k: (BASE[k], NEEDS[k]) for k in KINDS} | {k: (form, needed) for k, (form, needed, _) in LOOSE.items()}
    found = _matches(rows, forms)

    def named(field: str, name: str) -> Column:
        valid = F.filter(f"_{name}", lambda m: _valid(name, m["value"])) if name in BASE else F.col(f"_{name}")
        return F.transform(valid, lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(name) if name in BASE else len(KINDS)).alias("rank"), m["end"].alias("end"),
            F.lit(name).alias(field), m["value"].alias("value"), m["tail"].alias("tail"), m["cut"].alias("cut"),
        ))

    return found.select(
        "_row", "_key", F.array_sort(F.concat(*[named("kind", k) for k in KINDS])).alias("base"),
        F.concat(*[named("kind", k) for k in LOOSE]).alias("loose"),
    )


def _instances(found: DataFrame) -> DataFrame:
    """One row per base span and per looser match that meets none: (_row, kind, start, end, value, one, two), with pattern keys.

    Of looser matches that overlap, that which starts first stays.
    """
    every = found.where(F.size("loose") > 0).select("_row", F.explode(F.concat("base", "loose")).alias("m")).select("_row", "m.*")
    seeds = found.where((F.size("loose") == 0) & (F.size("base") > 0)).select("_row", F.explode("base").alias("m")).select("_row", "m.*")
    is_base = F.col("rank") < len(KINDS)
    before = "PARTITION BY _row ORDER BY start, rank, end, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    # backwards, since a frame that is open towards the end is read anew for every row
    after = "PARTITION BY _row ORDER BY start DESC, rank DESC, end DESC, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    met = every.withColumns({
        "ended": F.expr(f"max(end) OVER ({before})"),
        "next": F.expr(f"min(IF(rank < {len(KINDS)}, start, NULL)) OVER ({after})"),
    })
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    rows = met.where(is_base | free).drop("ended", "next").unionByName(seeds)
    words = rows.withColumn("words", words_of(F.col("tail")))
    # the first word of a tail that was cut may lack its beginning
    whole = F.size("words") - F.col("cut").cast("int")
    return words.select(
        "_row", "kind", "start", "end", F.lower(F.regexp_replace("value", "[^A-Za-z0-9@]", "")).alias("value"),
        F.when(whole >= 1, _pattern(F.element_at("words", -1))).alias("one"),
        F.when(whole >= 2, _pattern(F.element_at("words", -2), F.element_at("words", -1))).alias("two"),
    )


def _totals(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """How often each wanted pattern occurs in all texts, whatever follows it."""
    words = docs.select(words_of(F.col(f"`{text_col}`")).alias("w")).where(F.size("w") > 0)
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p"))
    keys = F.array(_pattern(F.col("p.a")), F.when(F.col("p.b").isNotNull(), _pattern(F.col("p.a"), F.col("p.b"))))
    seen = pairs.select(F.explode(keys).alias("pattern")).where("pattern IS NOT NULL")
    return seen.join(wanted.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def learn(docs: DataFrame, instances: DataFrame, text_col: str = "text", rounds: int = 4, support: int = 3, confidence: float = 0.6) -> DataFrame:
    """(form, value, kind, score): the looser matches that patterns name, with the kind they name them.

    A pattern is the word, or the two words, before an identifier. It is trusted for a kind when ``support`` different known
    identifiers of the kind follow it and, of its occurrences in all texts that no other kind follows, known identifiers take a
    share of at least ``confidence``. A looser match is known for a kind when the trusted patterns before its occurrences, taken
    as independent, leave a chance of at most 1 - ``confidence`` that none is right. Known matches count, by their score, in the next
    round, until a round finds no more or ``rounds`` are over.
    """
    edges = instances.select(F.explode(F.array("one", "two")).alias("pattern"), "kind", "value").where("pattern IS NOT NULL")
    graph = materialize(edges.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")))
    wanted = materialize(graph.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= support))
    totals = materialize(_totals(docs, text_col, wanted))
    graph = materialize(graph.join(totals, "pattern"))
    seeds = graph.where(F.col("kind").isin(*KINDS)).select("pattern", "total", "n", "kind", F.lit(1.0).alias("score"))
    kinds_of = reduce(lambda c, f: c.when(F.col("kind") == f, F.array(*map(F.lit, LOOSE[f][2]))), LOOSE, F.when(F.lit(False), F.array().cast("array<string>")))
    open_ = graph.where(F.col("kind").isin(*LOOSE)).select("pattern", "total", "n", F.col("kind").alias("form"), "value", F.explode(kinds_of).alias("kind"))
    fits = reduce(
        lambda c, k: c & ((F.col("kind") != k) | F.length(_digits(F.col("value"))).between(*DIGITS[k])), DIGITS, F.lit(True)
    )
    open_ = open_.where(fits)
    known, count = None, 0
    for _ in range(rounds):
        positive = seeds
        if known is not None:
            positive = seeds.unionByName(open_.join(known, ["form", "value", "kind"]).select("pattern", "total", "n", "kind", "score"))
        by_kind = positive.groupBy("pattern", "kind").agg(
            F.first("total").alias("total"), F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("values"),
        )
        of_pattern = by_kind.groupBy("pattern").agg(F.sum("hits").alias("all_hits"))
        rest = F.greatest(F.col("total") - (F.col("all_hits") - F.col("hits")), F.col("hits"))
        trusted = by_kind.join(of_pattern, "pattern").withColumn("trust", F.col("hits") / rest).where(
            (F.col("values") >= support) & (F.col("trust") >= confidence)
        ).select("pattern", "kind", F.least("trust", F.lit(0.999)).alias("trust"))
        named = open_.join(materialize(trusted), ["pattern", "kind"]).groupBy("form", "value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score")
        )
        best = F.max(F.struct("score", F.col("kind").alias("k"))).alias("best")
        known = materialize(
            named.where(F.col("score") >= confidence).groupBy("form", "value").agg(best).select("form", "value", F.col("best.k").alias("kind"), "best.score")
        )
        before, count = count, known.count()
        if count == before:
            break
    return known


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, support: int = 3,
                       confidence: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: ``_key`` (its id), ``base`` and ``spans``, both arrays of (kind, start, end) by start, then kind.

    ``base`` holds e-mail and IPv4 addresses, card numbers (14 to 19 digits, Luhn) and phone numbers (10 to 15 digits with a
    ``+``); a match that fails is dropped and not looked into again. ``spans`` adds identifiers of looser form (local and
    rewritten addresses, IPv6, other numbers) that the words before them give away, see ``learn``; one that is known
    counts wherever it occurs, unless it meets a base span. Places are code points, the end exclusive.

    Null, empty and blank texts have no spans. Rows with the same id or text each have their row; a null id stays null. Counts
    are taken over all rows, so copies count as often as they occur, but a pattern needs ``support`` different identifiers. Other columns are not
    read; an empty table gives an empty one.
    """
    found = written(base_spans(docs, id_col, text_col))
    instances = written(_instances(found))
    known = learn(docs, instances, text_col, rounds, support, confidence)
    loose = instances.where(F.col("kind").isin(*LOOSE)).select("_row", F.col("kind").alias("form"), "value", "start", "end")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = loose.join(known, ["form", "value"]).groupBy("_row").agg(
        F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("added")
    )
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    every = F.array_sort(F.concat(short, F.coalesce("added", F.array().cast("array<struct<start: long, rank: int, end: long, kind: string>>"))))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(added, "_row", "left").select("_key", plain(F.col("base")).alias("base"), plain(every).alias("spans"))

"""Label passes over the segments of a call.

Each pass is defined row by row, with later rows seeing earlier updates. Written that way it needs
one task per call. Every pass here is the closed form of that recursion, so it runs on running
values over blocks of a call:

* filling: between two confident labelled rows all rows face the same two candidates, and once a
  confident row has taken the right one, so do all after it;
* smoothing and short replies: a row changes exactly when its condition on the original labels
  holds and the row before did not change, so within a run of such rows every other one changes;
* zero similarity: only the two rows before an original customer row can change, which leaves a
  condition on two neighbours either way.

Segments have ``call_id, seg_idx`` (0, 1, 2 … without gaps), ``start_s, end_s, text, sim`` and a
label of four columns: ``speaker, role, display, agent_name``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    agent_phrase,
    backchannel_start,
    farewell,
    looks_like_question,
    short_customer_reply,
)
from ..storage import materialize
from .ordered import BLOCK_ROWS, after, before, following, key_max, previous, row_block, scan

LABEL = ["speaker", "role", "display", "agent_name"]

def _length() -> Column:
    return F.col("end_s") - F.col("start_s")


def _sim() -> Column:
    return F.coalesce(F.col("sim"), F.lit(0.0))



def _label(**values) -> Column:
    return F.struct(*[values.get(c, F.col(c)).cast("string").alias(c) for c in LABEL])


def _relabel(rows: DataFrame, columns: list[str], label: Column) -> DataFrame:
    """``columns`` with the label replaced by the struct ``label`` where that is not null."""
    held = rows.withColumn("__label", label)
    return held.select(
        *[
            F.when(F.col("__label").isNotNull(), F.col(f"__label.{c}")).otherwise(F.col(c)).alias(c)
            if c in LABEL else F.col(c)
            for c in columns
        ]
    )


def _scan(rows: DataFrame, values: dict, block_rows: int | None) -> DataFrame:
    block = None if block_rows is None else row_block("seg_idx", block_rows)
    return scan(rows, ["call_id"], ["seg_idx"], values, block)


def _cut(block_rows: int | None):
    """What to do between two scans: on blocks every scan reads its input twice, so a chain of
    them is written out in between; plain windows need one shuffle for the whole chain."""
    return (lambda df: df) if block_rows is None else materialize


def _alternate(rows: DataFrame, condition: str, block_rows: int | None) -> DataFrame:
    """Add ``__hit``: first, third, fifth … row of every run of rows with ``condition``."""
    c = F.coalesce(F.col(condition), F.lit(False))
    run = _scan(rows, {"__gap": before(F.when(~c, F.col("seg_idx")))}, block_rows)
    distance = F.col("seg_idx") - F.coalesce(F.col("__gap"), F.lit(-1))
    return run.withColumn("__hit", c & (distance % 2 == 1))


def fill_unlabelled(segments: DataFrame, confident_s: float = 1.0,
                    block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Rows without ``display`` take the label of the nearest confident row left or right.

    Equal labels are taken at once, otherwise the smaller gap decides, left on a tie. Filled rows
    that are long enough count as left neighbours for the rows after them. Calls without any
    confident label become Unknown.
    """
    columns = segments.columns
    long = _length() >= confident_s
    known = F.col("display").isNotNull() & (F.col("display") != "")
    ref = F.struct(_label().alias("label"), F.col("seg_idx").alias("idx"), F.col("start_s").alias("start"))
    seen = _scan(
        segments,
        {
            "__left": before(F.when(known & long, ref)),
            "__right": after(F.when(known & long, ref)),
            "__left_end": before(F.when(long, F.col("end_s"))),
        },
        block_rows,
    )
    left, right = F.col("__left"), F.col("__right")
    same = left["label"]["display"] == right["label"]["display"]
    nearer_left = F.col("start_s") - F.col("__left_end") <= right["start"] - F.col("end_s")
    turns_right = ~known & left.isNotNull() & right.isNotNull() & ~same & ~nearer_left
    marked = _scan(
        seen.withColumn("__turns", turns_right),
        {"__turned": before(F.when(F.col("__turns") & long, F.col("seg_idx")))},
        block_rows,
    )
    already = F.coalesce(F.col("__turned") > left["idx"], F.lit(False))
    take_right = left.isNull() | (right.isNotNull() & (F.col("__turns") | already))
    unknown = _label(
        speaker=F.lit("SPEAKER_99"), role=F.lit("CUSTOMER"), display=F.lit("Unknown"),
        agent_name=F.lit(None),
    )
    found = F.when(left.isNull() & right.isNull(), unknown).when(take_right, right["label"]).otherwise(left["label"])
    return _relabel(marked, columns, F.when(~known, found))


def _sandwich(segments: DataFrame, able: Column, sims: bool, strong: float,
              block_rows: int | None) -> DataFrame:
    columns = segments.columns
    values = {
        "__prev": previous(_label()), "__next": following(F.col("display")),
    }
    if sims:
        values |= {"__prev_sim": previous(_sim()), "__next_sim": following(_sim())}
    near = _scan(segments, values, block_rows)
    prev, nxt, cur = F.col("__prev.display"), F.col("__next"), F.col("display")
    inside = (prev == nxt) & (prev != "") & ~cur.eqNullSafe(prev)
    if sims:
        inside = inside & (F.greatest("__prev_sim", "__next_sim") >= strong)
    hit = _alternate(near.withColumn("__able", able & inside), "__able", block_rows)
    return _relabel(hit, columns, F.when(F.col("__hit"), F.col("__prev")))


def smooth_sandwich(segments: DataFrame, tight_s: float = 0.6, loose_s: float = 2.5,
                    weak: float = 0.30, strong: float = 0.40, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Short rows between two equal labels take that label.

    First rows up to ``tight_s``; then rows up to ``loose_s`` of weak similarity, when a neighbour
    is strong.
    """
    tight = _cut(block_rows)(_sandwich(segments, _length() <= tight_s, False, strong, block_rows))
    return _sandwich(tight, (_length() <= loose_s) & (_sim() < weak), True, strong, block_rows)


def demote_backchannel(segments: DataFrame, weak: float = 0.30, longest_s: float = 4.0,
                       most_words: int = 15) -> DataFrame:
    """Weak AGENT rows that open with a back-channel word become the first customer."""
    demoted = (
        (F.col("role") == "AGENT") & (_sim() < weak) & (_length() <= longest_s)
        & backchannel_start(F.col("text"), most_words)
    )
    first_customer = _label(
        speaker=F.lit("SPEAKER_01"), role=F.lit("CUSTOMER"), display=F.lit("Customer 1"),
        agent_name=F.lit(None),
    )
    return _relabel(segments, segments.columns, F.when(demoted, first_customer))


def demote_zero_sim(segments: DataFrame, zero: float = 0.10, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """AGENT rows of no similarity with a customer within two rows on both sides take the label of
    the adjacent customer, the one before first."""
    columns = segments.columns
    is_zero = (F.col("role") == "AGENT") & (_sim() < zero)
    state = F.struct((F.col("role") == "CUSTOMER").alias("cust"), is_zero.alias("zero"), _label().alias("label"))
    near = _scan(
        segments,
        {"__p1": previous(state), "__p2": previous(state, 2), "__n1": following(state), "__n2": following(state, 2)},
        block_rows,
    )
    cust = lambda c: F.coalesce(F.col(f"{c}.cust"), F.lit(False))
    before1, before2, next1, next2 = cust("__p1"), cust("__p2"), cust("__n1"), cust("__n2")
    demoted = is_zero & ((next1 & (before1 | before2)) | (~next1 & next2 & before1))
    # the row before was demoted itself: it is zero, follows a customer and this row's follower is one
    chained = ~before1 & before2 & F.coalesce(F.col("__p1.zero"), F.lit(False)) & next1
    label = (
        F.when(before1, F.col("__p1.label")).when(chained, F.col("__p2.label")).otherwise(F.col("__n1.label"))
    )
    return _relabel(near, columns, F.when(demoted, label))


def correct_roles(segments: DataFrame, short_s: float = 0.95, weak: float = 0.30,
                  farewell_sim: float = 0.18, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Short agent replies to an agent question go to the nearest customer; a customer farewell at
    the end of a call goes to the agent.

    Needs ``call_agent`` (the call's agent name) per row. Rows are expected in the order of their
    mid-points, as transcripts are. Adds nothing; returns the same columns.
    """
    cut = _cut(block_rows)
    columns = segments.columns
    agent, customer = F.col("role") == "AGENT", F.col("role") == "CUSTOMER"
    state = F.struct(
        agent.alias("agent"), customer.alias("cust"), looks_like_question(F.col("text")).alias("asks")
    )
    near = _scan(
        segments,
        {
            "__p1": previous(state), "__n1": following(state), "__n2": following(F.lit(True), 2),
            "__any": key_max(customer & F.col("display").isNotNull()),
        },
        block_rows,
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reply = (
        agent & (_length() <= short_s) & (_sim() <= weak) & ~agent_phrase(F.col("text"))
        & short_customer_reply(F.col("text")) & (yes("__p1.asks") | yes("__n1.cust")) & yes("__any")
    )
    bye = customer & (_length() <= short_s) & (_sim() >= farewell_sim) & farewell(F.col("text")) & F.col("__n2").isNull()
    flagged = near.withColumn("__reply", reply).withColumn("__bye", bye)
    flagged = _alternate(flagged.withColumn("__able", F.col("__reply") & yes("__p1.agent")), "__able", block_rows)
    # the last two rows: a farewell needs a customer before it, which an earlier change may be or undo
    flips = cut(flagged.select(
        *columns, "__reply", "__bye", "__hit", F.col("__p1.cust").alias("__pc"), F.col("__p1.agent").alias("__pa"),
        F.col("__n1").isNull().alias("__last"),
    ))
    prior = _scan(
        flips,
        {
            "__ph": previous(F.struct(F.col("__hit").alias("hit"), F.col("__bye").alias("bye"), F.col("__pc").alias("pc"))),
            "__pph": previous(F.col("__hit"), 2),
        },
        block_rows,
    )
    prev_hit = yes("__ph.hit")
    # whether the row before became the agent's: it can only be the last but one
    prev_bye = F.col("__last") & yes("__ph.bye") & (yes("__ph.pc") | yes("__pph")) 
    to_agent = F.col("__bye") & ((yes("__pc") & ~prev_bye) | prev_hit)
    to_customer = F.col("__hit") | (F.col("__reply") & F.col("__last") & prev_bye)
    decided = prior.withColumn("__to_agent", to_agent).withColumn("__to_customer", to_customer)
    decided = cut(decided.select(*columns, "__to_agent", "__to_customer"))
    # nearest customer by mid-point: customers as they were (without those turned agent before) and
    # rows turned customer before this one
    mid = (F.col("start_s") + F.col("end_s")) / 2
    point = F.struct(mid.alias("mid"), F.col("seg_idx").alias("idx"), _label().alias("label"))
    still = customer & F.col("display").isNotNull()
    looked = _scan(
        decided,
        {
            "__left": before(F.when(still & ~F.col("__to_agent"), point)),
            "__right": after(F.when(still, point)),
            "__turned": before(F.when(F.col("__to_customer"), F.struct(mid.alias("mid"), F.col("seg_idx").alias("idx")))),
        },
        block_rows,
    )
    gap = lambda c: F.struct(F.abs(mid - F.col(f"{c}.mid")), F.col(f"{c}.idx"))
    known = lambda c: F.col(c).isNotNull()
    left_wins = known("__left") & (~known("__right") | (gap("__left") <= gap("__right")))
    fixed_gap = F.when(left_wins, gap("__left")).otherwise(gap("__right"))
    fixed = F.when(left_wins, F.col("__left.label")).otherwise(F.col("__right.label"))
    follow = known("__turned") & F.coalesce(gap("__turned") < fixed_gap, F.lit(False))
    own = F.when(F.col("__to_customer") & ~follow, fixed)
    resolved = _scan(
        looked.withColumn("__own", own), {"__chain": before(F.col("__own"))}, block_rows
    )
    new_customer = F.coalesce(F.col("__own"), F.col("__chain"))
    new_agent = _label(
        speaker=F.lit("SPEAKER_00"), role=F.lit("AGENT"), display=F.col("call_agent"), agent_name=F.col("call_agent")
    )
    return _relabel(
        resolved, columns,
        F.when(F.col("__to_customer"), new_customer).when(F.col("__to_agent"), new_agent),
    )

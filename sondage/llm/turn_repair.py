"""Repair of the structure of conversations, as a fold in Spark SQL.

A conversation's rows are flagged by windows: blank, a repeat of an earlier row, or
truncated, whichever comes first, and whether a row's role may follow the one before.
The rows are then collected, sorted, and ``aggregate`` folds them into the cheapest
edits that leave the roles ``(s?(ua)+)?``. It carries four structs of cost and audit,
one a state of that pattern: nothing yet, after the system's row, after a user's and
after an assistant's. A row deletes itself, is kept or changes its role; before it and
at the end a user's or an assistant's row may be put in. ``least`` over the structs
picks the cheapest, then the first audit in ASCII order.

Prices: keep 0, change of role 2, delete 3, insert 2; a truncated row that stays 1 more.
A blank or repeated row must be deleted.

Why ``least`` at each row is enough: of two audits of one state that cost the same,
neither starts with the other (it would have inserts more, which cost), so whatever is
added to both leaves their order. Audits know inserted and changed roles apart by letters
that are next to each other, so they order as the plain ones do; roles are settled by
the pattern, so plain ones that are equal stay equal.

A conversation of more than ``BLOCK`` rows is folded block by block from each of the four
states, and the blocks' four by four results are folded in turn, so its cost doesn't
grow with the square of its rows.

Defined results: a null role or text is one space, and so is a null id or turn
where rows are damaged; null turns come first; rows of one turn are ordered by role and
text; null ids form one conversation; repeated rows stay and are flagged; a conversation
without rows gives zeros, an empty audit and the hash of the empty string; an empty
table gives an empty result; other columns are ignored. A conversation's rows are one
row of the result's job, as its repaired text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed prices.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters of edits, in the order of the plain ones: delete, insert user and assistant, keep, change to user and to assistant.
D, IU, IA, K, RU, RA = "DIJKRS"
#: Rows that are folded at once.
BLOCK = 256
#: More than any edits cost.
NEVER = 1 << 50
STATES = ("none", "system", "user", "assistant")
ENDS, BLANKS = "!.?", " \t\n\x0b\f\r"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows that are damaged by a hash of conversation and
    turn: of twenty, one is dropped, one emptied, one loses its ends of sentences, one is
    there twice, and one is the user's."""
    way = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.translate(_text("text"), ENDS, "")).otherwise(_text("text"))
    role = F.when(way == 4, "user").otherwise(_text("role"))
    times = F.array_repeat(F.lit(0), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).cast("int"))
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
    return kept.select("conv_id", "turn", "role", "text", F.explode("times").alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with ``fault`` (blank, duplicate, truncated or null) and ``illegal``. All windows
    use one partitioning, by conversation."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "nth")
    again = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text")).repartition("conv_id")
    rows = rows.withColumn("nth", F.row_number().over(again)).withColumn("initial", F.substring("role", 1, 1))
    before = F.lag("initial").over(by_turn)
    fault = F.when(trimmed == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(*ENDS), "truncated")
    return rows.select(
        "conv_id", "turn", "role", "text", "initial", fault.alias("fault"),
        (before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")).alias("illegal"),
        F.row_number().over(by_turn).alias("at"),
    )


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _add(path: Column, cost: Column | int, letters: str) -> Column:
    return _path(path["cost"] + cost, F.concat(path["audit"], F.lit(letters)))


def _states(*paths: Column) -> Column:
    return F.struct(*[p.alias(s) for s, p in zip(STATES, paths, strict=True)])


def _start(state: str) -> Column:
    return _states(*[_path(F.lit(0 if s == state else NEVER), F.lit("")) for s in STATES])


def _inserted(at: Column) -> Column:
    """The four paths after at most two inserts; more lead nowhere new."""
    none, system, user, assistant = (at[s] for s in STATES)
    return _states(
        none, system,
        F.least(user, *[_add(p, INSERT, IU) for p in (none, system, assistant)]),
        F.least(assistant, _add(user, INSERT, IA), *[_add(p, 2 * INSERT, IU + IA) for p in (none, system)]),
    )


def _edited(at: Column, row: Column) -> Column:
    """The four paths after a row."""
    none, system, user, assistant = (at[s] for s in STATES)
    gone = [_add(at[s], DELETE, D) for s in STATES]
    stays = ~F.coalesce(row["fault"].isin("blank", "duplicate"), F.lit(False))
    more = F.when(row["fault"] == "truncated", TRUNCATED).otherwise(0)
    keeps = lambda initial: F.when(stays & (row["initial"] == initial), more).otherwise(NEVER)
    turns = F.when(stays, more + REROLE).otherwise(NEVER)
    # the user's row may follow any of three; of those the best is taken before the edit is added
    any_ = F.least(none, system, assistant)
    return _states(
        gone[0],
        F.least(gone[1], _add(none, keeps("s"), K)),
        F.least(gone[2], _add(any_, keeps("u"), K), _add(any_, turns, RU)),
        F.least(gone[3], _add(user, keeps("a"), K), _add(user, turns, RA)),
    )


def _fold(rows: Column, start: Column) -> Column:
    return F.aggregate(rows, start, lambda at, row: _edited(_inserted(at), row))


def _folded(rows: Column) -> Column:
    """``_fold`` from the first state, a block of rows at a time where there are many."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")),
        lambda i: F.struct(*[_fold(F.slice(rows, i * BLOCK + 1, F.lit(BLOCK)), _start(s)).alias(s) for s in STATES]),
    )

    def join(at: Column, block: Column) -> Column:
        step = lambda a, b: _path(F.least(a["cost"] + b["cost"], F.lit(NEVER)), F.concat(a["audit"], b["audit"]))
        return _states(*[F.least(*[step(at[s], block[s][t]) for s in STATES]) for t in STATES])

    return F.when(F.size(rows) <= BLOCK, _fold(rows, _start("none"))).otherwise(F.aggregate(blocks, _start("none"), join))


def repaired(flags: DataFrame) -> DataFrame:
    """One row a conversation of ``flagged``: counts of faults, the cost and audit of the
    cheapest edits, with roles told apart, and ``messages``, the repaired rows."""
    row = F.struct("at", "turn", "role", "text", "initial", "fault")
    talks = flags.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(row)).alias("rows"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"),
    )
    talks = talks.withColumn("paths", _folded(F.transform("rows", lambda r: F.struct(r["initial"].alias("initial"), r["fault"].alias("fault")))))
    done = _inserted(F.col("paths"))
    talks = talks.withColumn("best", F.least(done["none"], done["assistant"]))
    audit = F.col("best.audit")
    # one part of the audit a row, and the inserts behind the last
    parts = F.regexp_extract_all(audit, F.lit(f"[{IU}{IA}]*[{D}{K}{RU}{RA}]"), F.lit(0))
    tail = F.regexp_extract(audit, f"[{IU}{IA}]*$", 0)

    def message(role: Column | str, text: Column) -> Column:
        return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))

    def put_in(letters: Column) -> Column:
        return F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: message(F.when(x == IU, "user").otherwise("assistant"), F.lit("")))

    def edits(part: Column, row: Column) -> Column:
        edit = F.right(part, F.lit(1))
        role = F.when(edit == K, row["role"]).when(edit == RU, "user").otherwise("assistant")
        own = F.array(message(role, row["text"]))
        return F.concat(put_in(F.rtrim(part, F.lit(D + K + RU + RA))), F.when(edit == D, F.slice(own, 1, 0)).otherwise(own))

    messages = F.concat(F.flatten(F.zip_with(parts, "rows", edits)), put_in(tail))
    return talks.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), audit.alias("edits"), messages.alias("messages"))


def digest(rows: DataFrame) -> DataFrame:
    """What ``repaired`` finds in the damaged rows of every conversation of ``rows``."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    found = repaired(flagged(damage(rows))).select(
        F.col("conv_id").alias("id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.translate("edits", IA + RA, IU + RU).alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = every.join(found, every["conv_id"].eqNullSafe(found["id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

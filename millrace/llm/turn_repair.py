"""Conversation structure repair: faults by windows, the cheapest edits by a fold over each conversation's turns (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What ends a sentence, and white space.
ENDS, SPACES = ".!?", " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than any conversation's edits cost: a state that can't be reached.
_FAR = 1 << 40
#: Edits are carried with the role that they give: an inserted or reroled user is I or R, an assistant J or S.
#: Two prefixes first differ in one of these letters only where they differ in an edit, so both orders agree.
_WITH_ROLES, _EDITS = "JS", "IR"


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and dropped of the turns, damaged by crc32("conv:turn") modulo 20.

    0 drops a turn (it stays as a row with dropped = true, so that no
    conversation is lost), 1 empties its text, 2 removes sentence ends from it,
    3 repeats it, 4 makes it the user's.  Null role or text is one space, and so
    is a null number or id in what is hashed.  Equal rows are damaged alike.
    """
    conv, turn = F.col(conv_col), F.col(turn_col)
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    own = turns.select(conv.alias("conv"), turn.alias("turn"), space(F.col(role_col)).alias("role"), space(F.col(text_col)).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return own.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")
    ).drop("copy")


def _flagged(turns: DataFrame) -> DataFrame:
    """Turns with their place among those that are left, their fault, and whether number and pair of initials are new or illegal."""
    whole = Window.partitionBy("conv").orderBy("dropped", F.asc_nulls_first("turn"), "role", "text")
    alike = Window.partitionBy("conv", "dropped", "role", "text").orderBy("nth")
    placed = turns.withColumn("initial", F.substring("role", 1, 1))
    placed = placed.withColumns({"nth": F.row_number().over(whole), "before": F.lag("initial").over(whole), "turn_before": F.lag("turn").over(whole)})
    placed = placed.withColumn("again", F.row_number().over(alike) > 1)
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", "blank").when(F.col("again"), "duplicate").when(~F.right(end, F.lit(1)).isin(*ENDS), "truncated")
    pair = F.concat("before", "initial")
    return placed.select(
        "conv", "turn", "role", "text", "dropped", "nth", "initial", F.coalesce(fault, F.lit("")).alias("fault"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column | int, edit: Column | str) -> Column:
    """What an edit makes of a state."""
    return _state(state["cost"] + (F.lit(cost) if isinstance(cost, int) else cost), F.concat(state["audit"], F.lit(edit) if isinstance(edit, str) else edit))


def _with_inserts(f: Column) -> tuple[Column, Column]:
    """The states behind a user and behind an assistant, after the inserts that are worth while (two at most)."""
    user = F.least(f["user"], _then(f["start"], INSERT, "I"), _then(f["system"], INSERT, "I"), _then(f["assistant"], INSERT, "I"))
    assistant = F.least(f["assistant"], _then(f["user"], INSERT, "J"), _then(f["start"], 2 * INSERT, "IJ"), _then(f["system"], 2 * INSERT, "IJ"))
    return user, assistant


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _edited(f: Column, x: Column) -> Column:
    """The cheapest edits, and of these the least, that end behind nothing, a system, a user and an assistant turn, after one turn more.

    Equally cheap edits of the same turns are never a proper prefix of each
    other (what one has more are inserts, which cost), so what is least now
    stays least whatever follows, and a state needs one struct.
    """
    stays = x["fault"].isin("", "truncated")
    late = F.when(x["fault"] == "truncated", TRUNCATED).otherwise(0)
    far = _state(F.lit(_FAR), F.lit(""))
    own = lambda initial: x["initial"] == initial
    gone = lambda state: _then(state, DELETE, "D")

    def edits(g: Column) -> Column:
        to_system = F.when(stays & own("s"), _then(g["start"], late, "K")).otherwise(far)
        to_user = F.when(stays, _then(g["before_user"], F.when(own("u"), late).otherwise(late + REROLE), F.when(own("u"), "K").otherwise("R"))).otherwise(far)
        to_assistant = F.when(stays, _then(g["user"], F.when(own("a"), late).otherwise(late + REROLE), F.when(own("a"), "K").otherwise("S"))).otherwise(far)
        return F.struct(
            gone(g["start"]).alias("start"), F.least(gone(g["system"]), to_system).alias("system"),
            F.least(gone(g["user"]), to_user).alias("user"), F.least(gone(g["assistant"]), to_assistant).alias("assistant"),
        )

    user, assistant = _with_inserts(f)
    inserted = F.struct(f["start"].alias("start"), f["system"].alias("system"), user.alias("user"), assistant.alias("assistant"))
    return _let(_let(inserted, lambda g: g.withField("before_user", F.least(g["start"], g["system"], g["assistant"]))), edits)


def _cheapest(turns: Column) -> Column:
    """(cost, audit) of sorted turns; the audit's letters tell roles as well."""
    at, far = _state(F.lit(0), F.lit("")), _state(F.lit(_FAR), F.lit(""))
    begin = F.struct(at.alias("start"), far.alias("system"), far.alias("user"), far.alias("assistant"))
    return F.aggregate(turns, begin, _edited, lambda f: F.least(f["start"], _with_inserts(f)[1]))


def _turn(role: Column | str, text: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(lit(role).alias("role"), lit(text).alias("text"))


def _inserted(letters: Column) -> Column:
    """The empty turns of I and J among the letters."""
    marks = F.filter(F.split(letters, ""), lambda c: c.isin("I", "J"))
    return F.transform(marks, lambda c: _turn(F.when(c == "I", "user").otherwise("assistant"), ""))


def _repaired(turns: Column, audit: Column) -> Column:
    """The turns that edits make: each turn's letters are the inserts before it and its own edit; the inserts at the end are its rest."""

    def one(turn: Column, letters: Column) -> Column:
        edit = F.right(letters, F.lit(1))
        role = F.when(edit == "R", "user").when(edit == "S", "assistant").otherwise(turn["role"])
        return F.concat(_inserted(letters), F.when(edit == "D", F.slice(F.array(_turn(turn["role"], turn["text"])), 1, 0)).otherwise(F.array(_turn(role, turn["text"]))))

    each = F.zip_with(turns, F.regexp_extract_all(audit, F.lit("([IJ]*[DKRS])"), F.lit(1)), one)
    return F.concat(F.flatten(each), _inserted(F.regexp_extract(audit, "([IJ]*)$", 1)))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv, turn, role, text, dropped; see damage()): faults, cost, audit, repaired.

    ``repaired`` are the role and text of the turns after the cheapest edits
    that bring the roles' initials to ``(s?(ua)+)?``; ``audit`` has the edits in
    order (Keep, Rerole, Delete, Insert), the least of equally cheap ones.  A
    role whose initial is none of s, u, a, an empty one too, can't be kept.

    Rows are exchanged once, by conversation; windows flag them, and one
    aggregate collects and folds them.  A conversation is one row of the result
    and is held by one task, as its repaired turns must be.

    Turns are ordered by number (nulls first), then role and text; rows equal in
    all three are turns of their own, of which the first is not a duplicate.
    Null ids form one conversation.  Nulls in role or text count as one space.
    An empty table gives an empty result; extra columns are ignored.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = turns.select("conv", "turn", space("role").alias("role"), space("text").alias("text"), "dropped")
    here = ~F.col("dropped")
    n = lambda c: F.coalesce(F.count_if(here & c), F.lit(0)).cast("long")
    number = F.when(here, F.col("turn"))
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  numbers may be as far apart as longs are
    span = F.coalesce(wide(F.max(number)) - wide(F.min(number)) + 1 - n(F.col("new_turn")), F.lit(0))
    span = F.least(span, F.lit(2**63 - 1).cast("decimal(20,0)"))
    faults = {k: n(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")}
    collected = F.array_sort(F.collect_list(F.when(here, F.struct("nth", "initial", "fault", "role", "text"))))
    found = _flagged(own).groupBy("conv").agg(span.cast("long").alias("gaps"), *faults.values(), n(F.col("illegal")).alias("illegal"), collected.alias("turns"))
    best = found.withColumn("best", _cheapest(F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault")))))
    return best.select(
        "conv", "gaps", *faults, "illegal", F.col("best.cost").alias("cost"), F.translate("best.audit", _WITH_ROLES, _EDITS).alias("audit"), _repaired(F.col("turns"), F.col("best.audit")).alias("repaired")
    )


def digest(repaired: Column) -> Column:
    """SHA-256 of the turns as lines of role:text."""
    return F.sha2(F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)

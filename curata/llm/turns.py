"""Operator 12: repair of conversation structure by a checkpointed dynamic program.

A conversation is well formed when its roles' initials read ``(s?(ua)+)?``. A row may be
kept (cost 0), given the other of user and assistant as its role (1) or deleted (2; blank
and duplicate rows must be), a message with empty text may be inserted anywhere (5), and a
truncated row that stays costs 5 more. The cheapest edits win; of equally cheap ones the
audit (the edits' initials in order) that is least in ASCII.

1. A skeleton of each row (turn, role initial, faults, digest of role and text), without its
   text, is joined with the first turn of its (conversation, digest), a pre-aggregated
   minimum, and streamed by conversation in order of turn.
2. ``cheapest_edits`` goes backward over one byte a row and stores the vector of costs to go
   (one per state: nothing yet, after system, after user, after assistant) only at every
   square-root-th row; walking forward it recomputes a block at a time and emits, of the
   edits that lie on a cheapest path, the least one. Each initial leads to one successor, so
   the least one at every step gives the least audit.
3. Texts are shuffled once, sorted behind the audit of their conversation, and streamed:
   messages leave, or are hashed, one by one.

A task holds a byte or two per row of one conversation at a time, as its audit does too,
and never its texts, so a conversation with a third of all rows needs no group in memory.

Defined results: null conv_id is a conversation of its own; null turns come first; null role
or text is one space; rows of one turn are taken in order of role, then of the digest of
role and text; repeated rows are duplicates; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import stage

SPACES = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CLEAN, CUT, GONE = 0, 1, 2                      # what is wrong with a row
EMPTY, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3     # states; the last three are also initials
_OTHER = 0
_NEXT = (USER, USER, ASSISTANT, USER)           # what may be put after a state by an edit
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_END = (0, 2 * INSERT, INSERT, 0)               # costs to go after the last row
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_AUDITS = "no_conv boolean, conv long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _kept_as(state: int, initial: int) -> int | None:
    """The state after keeping a row of this initial, if it may follow."""
    if initial == _NEXT[state] or (state == EMPTY and initial == SYSTEM):
        return initial
    return None


@lru_cache(maxsize=1 << 16)
def _step(costs: tuple[int, ...], initial: int, fault: int) -> tuple[int, ...]:
    """Costs to go before a row, from those after it."""
    stay = TRUNCATED if fault == CUT else 0
    found = []
    for state in range(4):
        ways = [DELETE + costs[state]]
        if fault != GONE:
            ways.append(RETYPE + stay + costs[_NEXT[state]])
            after = _kept_as(state, initial)
            if after is not None:
                ways.append(stay + costs[after])
        found.append(min(ways))
    for _ in range(3):  # messages inserted before the row
        found = [min(found[s], INSERT + found[_NEXT[s]]) for s in range(4)]
    return tuple(found)


def _back(costs: tuple[int, ...], row: int) -> tuple[int, ...]:
    least = min(costs)  # the step depends on differences only
    return tuple(c + least for c in _step(tuple(c - least for c in costs), row >> 2, row & 3))


def cheapest_edits(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation; a row is its initial's state times 4, plus its fault.

    Costs to go are stored only before every ``isqrt(n)``-th row; a block's own ones are
    worked out again when the walk enters it."""
    n = len(rows)
    block = max(1, isqrt(n))
    marks = {}
    costs = _END
    for i in range(n - 1, -1, -1):
        if (i + 1) % block == 0 or i == n - 1:
            marks[i + 1] = costs
        costs = _back(costs, rows[i])
    total, state, audit = costs[EMPTY], EMPTY, []
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        own = [marks[hi]]
        for i in range(hi - 1, lo - 1, -1):
            own.append(_back(own[-1], rows[i]))
        own.reverse()
        for i in range(lo, hi):
            now, after = own[i - lo], own[i - lo + 1]
            initial, fault = rows[i] >> 2, rows[i] & 3
            while now[state] != DELETE + after[state] and now[state] == INSERT + now[_NEXT[state]]:
                audit.append("I")
                state = _NEXT[state]
            if now[state] == DELETE + after[state]:
                audit.append("D")
                continue
            kept = _kept_as(state, initial)
            if kept is not None and now[state] == (TRUNCATED if fault == CUT else 0) + after[kept]:
                audit.append("K")
                state = kept
            else:
                audit.append("R")
                state = _NEXT[state]
    while _END[state]:
        audit.append("I")
        state = _NEXT[state]
    return total, "".join(audit)


def damage(rows: DataFrame) -> DataFrame:
    """The test damage of ``conversations``: by a hash of ``conv_id:turn`` rows go, lose
    their text or their sentence marks, come twice, or become the user's. A row that goes
    stays as a mark (``dropped``) of its conversation."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    how = F.crc32(named.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (how == 0).alias("dropped"),
        F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _prepared(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    named = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"), text.alias("text"), dropped.alias("dropped"),
    ).withColumn("digest", F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32)))


def audits(prepared: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and the audit of its repair."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(
        F.col("role").startswith("a"), ASSISTANT).otherwise(_OTHER)
    fault = F.when(last == "", 2).when(~last.isin(".", "!", "?"), 1).otherwise(0)
    skeleton = prepared.select("no_conv", "conv", "has_turn", "turn", "role", "digest", "dropped",
                               (initial * 4 + fault).cast("int").alias("kind"))
    place = F.struct("has_turn", "turn")
    seen = skeleton.where(~F.col("dropped")).groupBy("no_conv", "conv", "digest").agg(F.min(place).alias("seen"))
    rows = skeleton.join(seen, ["no_conv", "conv", "digest"], "left").select(
        "no_conv", "conv", "has_turn", "turn", "role", "digest", "dropped", "kind",
        F.coalesce(F.col("seen") < place, F.lit(False)).alias("again"))

    def run(batches):
        key = None
        kinds = marks = previous = None

        def result():
            blank, duplicate, truncated, illegal, first, last_turn, turns = marks
            cost, audit = cheapest_edits(bytes(kinds))
            gaps = last_turn - first + 1 - turns if turns else 0
            return (*key, gaps, blank, duplicate, truncated, illegal, cost, audit)

        names = ["no_conv", "conv", "has_turn", "turn", "digest", "dropped", "kind", "again"]
        for batch in batches:
            out = []
            for no_conv, conv, has_turn, turn, digest, dropped, kind, again in zip(*(batch[c].tolist() for c in names)):
                if key != (no_conv, conv):
                    if key is not None:
                        out.append(result())
                    key, kinds, previous, before = (no_conv, conv), bytearray(), None, None
                    marks = [0, 0, 0, 0, 0, 0, 0]
                if dropped:
                    continue
                if has_turn and (not marks[6] or turn != marks[5]):
                    if not marks[6]:
                        marks[4] = turn
                    marks[5] = turn
                    marks[6] += 1
                initial, fault = kind >> 2, kind & 3
                if kinds and (kinds[-1] >> 2, initial) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
                    marks[3] += 1
                if fault == 2:
                    marks[0] += 1
                    fault = GONE
                elif again or previous == (has_turn, turn, digest):
                    marks[1] += 1
                    fault = GONE
                elif fault == 1:
                    marks[2] += 1
                    fault = CUT
                previous = (has_turn, turn, digest)
                kinds.append(initial * 4 + fault)
            if out:
                yield pd.DataFrame(out, columns=["no_conv", "conv", *_COUNTS, "audit"])
        if key is not None:
            yield pd.DataFrame([result()], columns=["no_conv", "conv", *_COUNTS, "audit"])

    ordered = rows.repartition("no_conv", "conv").sortWithinPartitions(
        "no_conv", "conv", "has_turn", "turn", "role", "digest").drop("role")
    return ordered.mapInPandas(run, _AUDITS)


def _streamed(prepared: DataFrame, found: DataFrame) -> DataFrame:
    """Texts sorted behind the audit of their conversation, in the order of the audit."""
    texts = prepared.where(~F.col("dropped")).select("no_conv", "conv", "has_turn", "turn", "role", "digest", "text")
    heads = found.select("no_conv", "conv", F.col("audit").alias("text"), *_COUNTS)
    both = heads.withColumn("is_text", F.lit(False)).unionByName(
        texts.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    return both.repartition("no_conv", "conv").sortWithinPartitions(
        "no_conv", "conv", "is_text", "has_turn", "turn", "role", "digest")


def _messages(rows):
    """For each streamed row: ('head', row), or ('message', edit, role, text) as the audit
    of its conversation tells; ('end',) after each conversation."""
    audit, at, state, opened = "", 0, EMPTY, False

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield "message", "I", _ROLE[state], ""

    for row in rows:
        if not row[0]:
            if opened:
                yield from inserted()
                yield ("end",)
            audit, at, state, opened = row[2], 0, EMPTY, True
            yield "head", row
            continue
        yield from inserted()
        edit, role, text = audit[at], row[1], row[2]
        at += 1
        if edit == "K":
            state = SYSTEM if role.startswith("s") else USER if role.startswith("u") else ASSISTANT
            yield "message", edit, role, text
        elif edit == "R":
            state = _NEXT[state]
            yield "message", edit, _ROLE[state], text
    if opened:
        yield from inserted()
        yield ("end",)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the messages of every conversation after repair."""
    prepared = _prepared(conversations)

    def run(batches):
        def rows():
            for batch in batches:
                names = ["is_text", "role", "text", "no_conv", "conv"]
                yield from zip(*(batch[c].tolist() for c in names))

        out, held, place, key = [], 0, 0, None
        for event in _messages(rows()):
            if event[0] == "head":
                key, place = (None if event[1][3] else str(event[1][4])), 0
            elif event[0] == "message":
                out.append((key, place, *event[1:]))
                place, held = place + 1, held + len(event[3]) + 64
                if held > 1 << 20:
                    yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])

    done = _streamed(prepared, stage(audits(prepared), "turn-audits")).select(
        "is_text", "role", "text", "no_conv", "conv").mapInPandas(
        run, "key string, place long, edit string, role string, text string")
    return done.select(F.col("key").cast("long").alias("conv_id"), "place", "edit", "role", "text")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost and audit of its repair, and the SHA-256 of the
    repaired messages (``role:text``, joined by line feeds)."""
    prepared = _prepared(conversations)

    def run(batches):
        names = ["is_text", "role", "text", "no_conv", "conv", *_COUNTS]

        def rows():
            for batch in batches:
                yield from zip(*(batch[c].tolist() for c in names))

        out, head, digest, later = [], None, None, False
        for event in _messages(rows()):
            if event[0] == "head":
                head, digest, later = event[1], hashlib.sha256(), False
            elif event[0] == "message":
                digest.update(f"{chr(10) if later else ''}{event[2]}:{event[3]}".encode())
                later = True
            else:
                out.append((None if head[3] else str(head[4]), *(int(x) for x in head[5:]), head[2], digest.hexdigest()))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["key", *_COUNTS, "audit", "repaired_sha256"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["key", *_COUNTS, "audit", "repaired_sha256"])

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    done = _streamed(prepared, stage(audits(prepared), "turn-audits")).select(
        "is_text", "role", "text", "no_conv", "conv", *_COUNTS).mapInPandas(
        run, f"key string, {counts}, audit string, repaired_sha256 string")
    return done.select(F.col("key").cast("long").alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")

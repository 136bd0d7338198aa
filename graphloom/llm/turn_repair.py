"""Structure repair of conversations: the cheapest edits that give well-formed turns.

Rows are dealt by conversation and every row goes through its task's stream twice: first
without text from the last turn to the first, then with text from the first to the last.
The way back carries the state of a dynamic program over the four places of the grammar
``(s?(ua)+)?`` across Arrow batches and leaves one byte a row, the best edit for each
place; those bytes spill to an unnamed file of the task when a conversation is giant. The
way forth reads them from the end and edits the rows. So a task holds a state, a batch and
a bounded buffer, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

WHITE = r"\x20\x09-\x0D"
# bytes of backpointers that a task keeps in memory, and those read back at a time
HELD_BYTES = 1 << 24
READ_BYTES = 1 << 16
# costs of edits; undeleted truncated rows cost more, blank and repeated ones must go
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SOUND, MUST_GO, CUT_OFF = 0, 1, 2
# places: nothing yet, after the system row, after user, after assistant
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# what a place asks for, which is what an insert or a new role gives
_WANTED = ("u", "u", "a", "u")
_NAMES = {"u": "user", "a": "assistant"}
# edits by code, in ASCII order of their initials
EDITS = "DIKR"
# cost of the rest when no row is left, and by what edit
_END = (0, 2 * INSERT, INSERT, 0)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv string, step long, edit string, turn long, role string, text string"


def step_back(rest: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs from each place on, before a row instead of behind it, and the edits to choose, two bits a place."""
    extra = TRUNCATED if fault == CUT_OFF else 0
    options: list[dict[int, int]] = []
    for place in range(4):
        ways = {0: DELETE + rest[place]}
        if fault != MUST_GO:
            if initial in _NEXT[place]:
                ways[2] = KEEP + extra + rest[_NEXT[place][initial]]
            ways[3] = REROLE + extra + rest[_NEXT[place][_WANTED[place]]]
        options.append(ways)
    costs = [min(ways.values()) for ways in options]
    for _ in range(3):  # inserts lead on at most three places before they repeat
        for place in range(4):
            costs[place] = min(costs[place], INSERT + costs[_NEXT[place][_WANTED[place]]])
    chosen = 0
    for place, ways in enumerate(options):
        ways[1] = INSERT + costs[_NEXT[place][_WANTED[place]]]
        chosen |= min(code for code, cost in ways.items() if cost == costs[place]) << 2 * place
    return tuple(costs), chosen


class _Conversation:
    """State of one conversation: the way back first, then the way forth."""

    def __init__(self, conv: str):
        self.conv = conv
        self.counts = dict.fromkeys(COUNTS, 0)
        self.rest, self.base = _END, 0
        self.spill = tempfile.SpooledTemporaryFile(max_size=HELD_BYTES)
        self.rows = 0
        self.behind: tuple | None = None
        self.turns = self.low = self.high = None
        self.ahead = b""
        self.place = self.step = 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def close(self) -> None:
        self.spill.close()

    def back(self, part: pd.DataFrame, memo: dict) -> None:
        """Rows of the conversation, from the last on."""
        codes = bytearray()
        rest, base = self.rest, self.base
        counts = self.counts
        for initial, fault, kind, has_turn, turn in zip(part["initial"], part["fault"], part["kind"], part["has_turn"], part["turn"]):
            if kind:
                counts[kind] += 1
            if self.behind is not None and initial + self.behind[0] not in ("su", "ua", "au"):
                counts["illegal"] += 1
            if has_turn:
                if self.high is None:
                    self.high, self.turns = turn, 0
                if self.low != turn:
                    self.low, self.turns = turn, self.turns + 1
            self.behind = (initial,)
            key = (rest, initial, fault)
            if key not in memo:
                costs, chosen = step_back(rest, initial, fault)
                least = min(costs)
                memo[key] = tuple(c - least for c in costs), least, chosen
            rest, least, chosen = memo[key]
            base += least
            codes.append(chosen)
        self.spill.write(bytes(codes))
        self.rows += len(codes)
        self.rest, self.base = rest, base

    def turned(self) -> None:
        """From the way back to the way forth."""
        self.counts["cost"] = self.base + self.rest[0]
        if self.high is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        self.left = self.rows

    def _code(self) -> int:
        if not self.ahead:
            n = min(READ_BYTES, self.left)
            self.left -= n
            self.spill.seek(self.left)
            self.ahead = self.spill.read(n)
        code, self.ahead = self.ahead[-1], self.ahead[:-1]
        return code

    def _emit(self, edit: str, turn, role: str, text: str, out: list | None) -> None:
        if edit != "D":
            if self.place:  # nothing stands before the first row only
                self.digest.update(b"\n")
            self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.place = _NEXT[self.place][role[:1]]
        self.audit.append(edit)
        if out is not None:
            out.append((self.conv, self.step, edit, turn, role, text))
        self.step += 1

    def forth(self, part: pd.DataFrame, out: list | None) -> None:
        """Rows with text, from the first on."""
        for role, text, has_turn, turn in zip(part["role"], part["text"], part["has_turn"], part["turn"]):
            code = self._code()
            while (edit := EDITS[code >> 2 * self.place & 3]) == "I":
                self._emit("I", None, _NAMES[_WANTED[self.place]], "", out)
            self._emit(edit, turn if has_turn else None, _NAMES[_WANTED[self.place]] if edit == "R" else role, text, out)

    def end(self, out: list | None) -> tuple:
        while self.place in (1, 2):
            self._emit("I", None, _NAMES[_WANTED[self.place]], "", out)
        self.close()
        return (self.conv, *(self.counts[c] for c in COUNTS), "".join(self.audit), self.digest.hexdigest())


def _repair(turns: bool):
    """Streams rows sorted by (conv, phase, place): phase 0 marks, 1 back, 2 forth."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        now: _Conversation | None = None
        phase = 0
        for batch in batches:
            if batch.empty:
                continue
            out: list | None = [] if turns else None
            ended: list = []
            new = (batch["conv"] != batch["conv"].shift()) | (batch["phase"] != batch["phase"].shift())
            cuts = [*new.to_numpy().nonzero()[0], len(batch)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                part = batch.iloc[a:z]
                conv = part["conv"].iat[0]
                if now is None or now.conv != conv:
                    if now is not None:
                        ended.append(now.end(out))
                    now, phase = _Conversation(conv), 0
                at = part["phase"].iat[0]
                if at == 1:
                    now.back(part, memo)
                elif at == 2:
                    if phase != 2:
                        now.turned()
                    now.forth(part, out)
                phase = at
            yield from _frames(out, ended)
        if now is not None:
            out = [] if turns else None
            yield from _frames(out, [now.end(out)])

    def _frames(out: list | None, ended: list) -> Iterator[pd.DataFrame]:
        if turns and out:
            frame = pd.DataFrame(out, columns=["conv", "step", "edit", "turn", "role", "text"])
            frame["turn"] = frame["turn"].astype("Int64")
            yield frame
        elif not turns and ended:
            yield pd.DataFrame(ended, columns=["conv", *COUNTS, "audit", "repaired_sha256"])

    return rows


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) with planted faults.

    crc32 of ``conv_id:turn`` modulo 20 drops a row (0, it stays with ``dropped``
    set, so that its conversation is known), empties its text (1), takes out its
    ``[.!?]`` (2), repeats it (3) or makes it a user's (4). A null is one space.
    """
    fate = F.crc32(F.concat_ws(":", _filled("conv_id"), _filled("turn"))) % 20
    rows = messages.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fate") == 0).alias("dropped"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _streamed(messages: DataFrame) -> DataFrame:
    """Each row twice, without text from the end and with text from the start, in its conversation's task."""
    columns = messages.columns
    dropped = F.col("dropped") if "dropped" in columns else F.lit(False)
    key = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("c"), _filled("conv_id"))
    rows = messages.select(
        key.alias("conv"), F.col("turn").cast("bigint").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"),
        F.coalesce(dropped, F.lit(False)).alias("dropped"),
    )
    faults = rows.select(
        "*", F.md5(F.concat_ws("\n", "dropped", "role", "text")).alias("same"),
        F.substring("role", 1, 1).alias("initial"),
        F.regexp_like("text", F.lit(f"[^{WHITE}]")).alias("worded"),
        F.regexp_like("text", F.lit(rf"[.!?][{WHITE}]*\z")).alias("closed"),
    ).repartition("conv")
    # both windows keep the conversation's rows in their task: no further exchange
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("seen")]
    seen = F.row_number().over(Window.partitionBy("conv", "same").orderBy(F.asc_nulls_first("turn"))) > 1
    place = F.row_number().over(Window.partitionBy("conv").orderBy(*order)).cast("bigint")
    kind = F.when(~F.col("worded"), "blank").when(F.col("seen"), "duplicate").when(~F.col("closed"), "truncated").otherwise("")
    code = F.when(F.col("kind").isin("blank", "duplicate"), MUST_GO).when(F.col("kind") == "truncated", CUT_OFF).otherwise(SOUND)
    placed = faults.withColumn("seen", seen).withColumn("place", place).withColumn("kind", kind).withColumn("fault", code)
    # the first row of any kind carries the conversation, so one that lost every row is known
    phase = lambda n, at, text: F.struct(F.lit(n).alias("phase"), at.alias("at"), text.alias("text"))
    both = F.when(F.col("dropped"), F.array(phase(0, F.lit(0).cast("bigint"), F.lit("")))).otherwise(
        F.array(phase(1, -F.col("place"), F.lit("")), phase(2, F.col("place"), F.col("text")))
    )
    twice = placed.select(
        "conv", "role", "initial", "kind", "fault", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), F.inline(both)
    )
    return twice.sortWithinPartitions("conv", "phase", "at").drop("at")


def _named(found: DataFrame, messages: DataFrame) -> DataFrame:
    conv_id = F.when(F.col("conv").startswith("c"), F.expr("substring(conv, 2)")).cast(messages.schema["conv_id"].dataType).alias("conv_id")
    return found.select(conv_id, *[c for c in found.columns if c != "conv"])


def repair_report(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one per conversation.

    ``messages`` holds conv_id, turn, role and text; where a boolean ``dropped``
    is set the row only names its conversation. Other columns are ignored. Rows
    stand by turn, nulls first, equal turns by role and text. A null role or text
    is one space, a null conv_id is a conversation of its own. Of each row's faults
    the first counts: blank, duplicate (role and text seen earlier), truncated.
    ``audit`` has the initial of each edit (Delete, Insert, Keep, Rerole) of the
    cheapest repair, the ASCII-least of equally cheap ones; the hash is of the
    repaired ``role:text`` joined by newlines. No rows give no conversations.
    """
    return _named(_streamed(messages).mapInPandas(_repair(False), REPORT), messages)


def repaired_turns(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, step, edit, turn, role, text): every edit of the cheapest repair, deleted rows included.

    Rows as ``repair_report`` takes them. Inserted rows have no turn and an empty
    text; a row with edit R has its new role.
    """
    return _named(_streamed(messages).mapInPandas(_repair(True), TURNS), messages)

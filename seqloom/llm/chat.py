"""Chat formatting in budgeted windows.

A conversation is written into one or more windows of at most ``budget`` tokens. Prefix
sums of the turns' token counts choose turn-aligned spans: a window takes as many new
turns as fit. Every window after the first begins with the system turn (the
conversation's first turn, if its role is ``system``) and with the last turns before
it, up to ``history`` tokens; these repeats are outside the loss mask, so each assistant
text is a target exactly once. History gives way first where the next turn would not fit;
where the system turn and the next turn together exceed the budget, that window begins
without the system turn. A turn that alone exceeds the budget gets a window of its own and
keeps its whole text, so a window of more than ``budget`` tokens holds one turn.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Inside roles and texts a
backslash is doubled and every control string (of this template and of common others)
is broken by a backslash after its first character; removing one backslash before any
character undoes both, so texts come back exactly.

Rows are ordered by turn (null first), then role and text. Turns stream through a
partition sorted by conversation and only the current window, its history and the system
turn are held, so a conversation of any length needs the memory of one window. Where a window
begins depends on the one before it, and the digest of a conversation on all its turns in
order, so a conversation is read by one task from end to end, streaming; null ids are one
conversation.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own;
repeated rows are turns of their own; an empty table gives no window; other columns are
ignored. Tokens are runs of letters or digits and single other characters, not white
space (a fixed estimate; any count can be passed as ``tokens``).
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that no text may bring into the output: the template's own and common others.
CONTROL = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
)
BUDGET, HISTORY = 512, 128

_BREAK = re.compile("|".join(re.escape(c) for c in (*CONTROL, "\\")))
_UNBREAK = re.compile(r"\\(.)", re.S)
_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")

#: Tokens that the markers of a turn count for.
FRAME = 3

WINDOWS = (
    "conv_id bigint, window bigint, repeated int, n_tokens bigint, formatted string, "
    "loss array<struct<start:bigint,end:bigint>>"
)


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _UNBREAK.sub(r"\1", text)


def count_tokens(text: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(text))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a window."""
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


class Windower:
    """Cuts the turns of one conversation, fed in order, into windows."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: deque[tuple[str, str, int]] = deque()
        self.past_tokens = 0
        self.head: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.total = self.start = 0  # prefix sums: at the last turn, before the window's first new turn
        self.n = 0
        self.first = True

    def feed(self, role: str, text: str, tokens: int):
        """The finished window, if this turn begins another."""
        turn, done = (role, text, tokens), None
        room = self.budget - sum(t for _, _, t in self.head)
        if self.new and self.total + tokens - self.start > room:
            done = self.close()
            self._open(tokens)
        self.total += tokens
        self.new.append(turn)
        if self.first:
            self.first = False
            if role == "system":
                self.system = turn
        return done

    def _open(self, tokens: int) -> None:
        """History goes when it would keep the next turn out of the window."""
        head = [self.system] if self.system and self.system[2] + tokens <= self.budget else []
        room = self.budget - sum(t for _, _, t in head) - tokens
        past, held = list(self.past), self.past_tokens
        while past and held > room:
            held -= past.pop(0)[2]
        self.head = head + past
        self.start = self.total

    def close(self):
        """(repeated turns, tokens, text, loss spans) of the window at hand."""
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(self.head + self.new):
            lead = TURN + escape(role) + TEXT
            body = escape(text)
            if i >= len(self.head) and role == "assistant" and body:
                loss.append({"start": at + len(lead), "end": at + len(lead) + len(body)})
            parts.append(lead + body + END)
            at += len(parts[-1])
        tokens = sum(t for _, _, t in self.head) + self.total - self.start
        out = (len(self.head), tokens, "".join(parts), loss)
        for turn in self.new:
            if turn is not self.system:
                self.past.append(turn)
                self.past_tokens += turn[2]
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[2]
        self.new, self.n = [], self.n + 1
        return out


def chat_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_tokens
) -> DataFrame:
    """Windows of conversations: conv_id, window, repeated (turns at its head that were
    written before), n_tokens, formatted, loss (code-point spans of target text)."""
    bounded_batches(turns.sparkSession)

    def run(batches):
        import pyarrow as pa

        loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        now, at = None, None
        for batch in batches:
            rows: list[tuple] = []

            def emit(done, conv, n):
                rows.append((conv, n, *done))

            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or conv != at:
                    if now is not None:
                        emit(now.close(), at, now.n - 1)
                    now, at = Windower(budget, history), conv
                if done := now.feed(role, text, tokens(text) + FRAME):
                    emit(done, conv, now.n - 1)
            yield _batch(rows, loss_type)
        if now is not None:
            yield _batch([(at, now.n, *now.close())], loss_type)

    ordered = (
        turns.select(
            F.col("conv_id").cast("bigint"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )
    return ordered.mapInArrow(tidy(run), WINDOWS)


def _batch(rows: list[tuple], loss_type):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), loss_type]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, kinds)],
        names=["conv_id", "window", "repeated", "n_tokens", "formatted", "loss"],
    )


READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_windows bigint, n_tokens bigint"
)


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """One row a conversation, from formatted text, masks and ``repeated`` alone.

    ``in_order``: the rows come straight from ``chat_windows``, conversations whole and windows in order.
    """
    bounded_batches(windows.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        state = None

        def result(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6], s[7])

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            names = [x.split()[0] for x in READ.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "repeated", "n_tokens", "formatted", "loss"))
            for conv, repeated, n_tokens, formatted, loss in zip(*columns):
                if state is None or conv != state[0]:
                    if state is not None:
                        rows.append(result(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(formatted)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(formatted[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
                state[6] += 1
                state[7] += n_tokens
            yield batch_of(rows)
        if state is not None:
            yield batch_of([result(state)])

    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return windows.mapInArrow(tidy(run), READ)


def chat_report(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    trial = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", trial), (-1, 1, "assistant", trial)], "conv_id bigint, turn bigint, role string, text string"
    )
    windows = chat_windows(conversations.select("conv_id", "turn", "role", "text").unionByName(extra))
    return read_back(windows, in_order=True)


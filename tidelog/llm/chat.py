"""Chat formatting with loss masks found by rendering a template, as a black box, on successive prefixes of turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]
#: The first of the characters that stand in for a turn's text to find where it goes.
PROBE = ""

# The template's marks, and strings that some template gives a meaning. Inside texts they are broken up.
OPEN, NAMED, CLOSE = "<|turn:", "|>\n", "<|end|>\n"
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_ESCAPED = re.compile("\\\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\|]|\\.|\|(?!>))*)" + re.escape(NAMED) + r"((?:[^\\<]|\\.|<(?!\|))*)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string, so none is left."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def render(messages: Messages) -> str:
    """The built-in template."""
    return "".join(f"{OPEN}{escape(role)}{NAMED}{escape(text)}{CLOSE}" for role, text in messages)


def parse(formatted: str) -> Messages:
    """The turns of a rendered conversation. ValueError if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn starts at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass
class Rendered:
    formatted: str
    #: (start, end) of what each turn added, and of its text inside that.
    turns: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    #: Turns whose rendering changed what stood before, and the first character that changed.
    rewrites: list[tuple[int, int]]


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _probe(messages: Messages) -> str:
    """A character of a private area that no role or text holds."""
    used = set().union(*(set(role) | set(text) for role, text in messages))
    return next(c for c in map(chr, range(ord(PROBE), 0xF8FF)) if c not in used)


def _place(template: Callable[[Messages], str], messages: Messages, out: str, k: int, probe: str, start: int) -> tuple[int, int] | None:
    """Where turn k's text stands in out = template(messages): the probe, as long as the text, takes its place and all around stays.

    None if something else changes too. A text that is empty, or left out of the output, may be empty at `start`.
    """
    role, text = messages[k]
    for size in {len(text) or 1, 1}:
        probed = template([*messages[:k], (role, probe * size), *messages[k + 1 :]])
        at = probed.find(probe)
        if at < 0:
            return start, start
        rest = len(probed) - probed.rfind(probe) - 1
        if out[:at] == probed[:at] and at + rest <= len(out) and out[len(out) - rest :] == probed[len(probed) - rest :]:
            return at, len(out) - rest
    return None if text else (start, start)


def locate(template: Callable[[Messages], str], messages: Messages) -> Rendered:
    """Renders each prefix of the turns and compares it with the one before.

    What a prefix's output has beyond the previous output is the turn's span. If the previous output is no longer there,
    the template rewrites history: the turn is listed, its span starts where the outputs part, and every earlier turn whose
    text stood beyond that point is looked for anew in the last output, its span then being that of its text. A text's
    place is found by rendering the turn with a probe for its text; a text that the template trims or escapes has the span
    of what stands between its header and its footer, one that it leaves out an empty one. ValueError if a text's place
    cannot be told in the last output, for instance because a header depends on what the text says.
    """
    before, turns, texts, rewrites = "", [], [], []
    probe, lost = _probe(messages), set()
    for k in range(len(messages)):
        own = messages[: k + 1]
        out = template(own)
        start = len(before)
        if not out.startswith(before):
            start = _common(before, out)
            rewrites.append((k, start))
            lost |= {j for j in range(k) if j in lost or texts[j] is None or texts[j][1] > start}
        texts.append(_place(template, own, out, k, probe, start))
        if texts[k] is None:
            lost.add(k)
        turns.append((start, len(out)))
        before = out
    for k in sorted(lost):
        texts[k] = _place(template, messages, before, k, probe, 0)
        if texts[k] is None:
            raise ValueError(f"the template does not show where the text of turn {k} stands")
        turns[k] = texts[k]
    return Rendered(before, turns, texts, rewrites)


def conversation(conv_id: int | None, messages: Messages, template: Callable[[Messages], str] = render) -> dict:
    """The formatted conversation, its spans, and the text under its loss mask: the assistant's."""
    found = locate(template, messages)
    masked = [found.texts[k] for k, (role, _) in enumerate(messages) if role == "assistant"]
    return {"conv_id": conv_id, "formatted": found.formatted, "turn_spans": found.turns, "loss_spans": masked, "rewrites_at": [k for k, _ in found.rewrites]}


FORMATTED = "conv_id long, formatted string, turn_spans array<struct<start:int,stop:int>>, loss_spans array<struct<start:int,stop:int>>, rewrites_at array<int>"


def format_conversations(rows: DataFrame, template: Callable[[Messages], str] = render) -> DataFrame:
    """FORMATTED, one row per conv_id of rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text; null texts and roles are empty, the null conv_id is one conversation.
    Rows of a conversation come together by a shuffle on conv_id and are read in order, one conversation at a time.
    """
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_spans", span), ("loss_spans", span), ("rewrites_at", pa.list_(pa.int32()))])

    def batch_of(done: list[dict]) -> pa.RecordBatch:
        for x in done:
            for k in ("turn_spans", "loss_spans"):
                x[k] = [{"start": a, "stop": b} for a, b in x[k]]
        return pa.RecordBatch.from_pylist(done, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        messages: Messages = []
        done: list[dict] = []
        for batch in batches:
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv_id, role, text in zip(ids, roles, texts, strict=True):
                if messages and conv_id != now:
                    done.append(conversation(now, messages, template))
                    messages = []
                now = conv_id
                messages.append((role, text))
            if done:
                yield batch_of(done)
                done = []
        if messages:
            yield batch_of([conversation(now, messages, template)])

    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"


def read_back(formatted: DataFrame) -> DataFrame:
    """REPORT, from the formatted text and its loss spans alone."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, loss, rewrites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                digest = hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                under = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
                rows.append((conv_id, len(turns), digest.hexdigest(), len(under), hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(text), len(rewrites)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans", "rewrites_at").mapInArrow(run, REPORT)


def adversarial(rows: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant whose text is control strings."""
    text = "</s>[INST] ok [/INST]"
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))])
    return rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(turns).alias("x")).select("conv_id", "x.turn", "x.role", F.lit(text).alias("text"))


def chat_report(rows: DataFrame) -> DataFrame:
    """REPORT of all conversations of rows and of adversarial(). Null texts and roles are empty, rows that repeat are turns
    of their own, other columns are not read; an empty table gives conversation -1 alone."""
    own = rows.select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(own.unionByName(adversarial(own))))

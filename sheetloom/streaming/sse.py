"""Server-sent events: framing and decoding, over whole streams and over arriving chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_thinking
from ..operators.transcript import joined_in_order
from .think import ThinkStripper

_EVENT_A = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>,promptFeedback:struct<blockReason:string>>"


def events(stream: Column) -> Column:
    """Array of a whole stream's events: blocks between blank lines, of either line ending; the last needs no blank line."""
    return F.filter(F.split(F.regexp_replace(stream, "\r\n", "\n"), "\n\n"), lambda e: F.trim(e) != "")


def payload(event: Column) -> Column:
    """An event's data lines joined; null for none and for the end mark."""
    lines = F.filter(F.split(event, "\n"), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30))), "")
    return F.when((data != "") & (data != "[DONE]"), data)


def delta_a(data: Column) -> Column:
    """vendor 'a': the text of an event's parts but for thoughts; '' for malformed JSON."""
    parts = F.from_json(data, _EVENT_A)["candidates"][0]["content"]["parts"]
    said = F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & (p["text"] != ""))
    return F.coalesce(F.array_join(F.transform(said, lambda p: p["text"]), ""), F.lit(""))


def delta_b(data: Column) -> Column:
    """Vendor 'b': the content of the first choice's delta; '' for none or malformed JSON."""
    return F.coalesce(F.get_json_object(data, "$.choices[0].delta.content"), F.lit(""))


def decode_stream(stream: Column, vendor: str = "a") -> Column:
    """The whole answer in a whole stream."""
    data = F.filter(F.transform(events(stream), payload), lambda d: d.isNotNull())
    said = F.array_join(F.transform(data, delta_a if vendor == "a" else delta_b), "")
    return strip_thinking(said) if vendor == "b" else said


def decode_chunks(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk", vendor: str = "a") -> DataFrame:
    """The answer of each stream from its chunks in order. A stream is one response, so its chunks fit a task."""
    whole = chunks.groupBy(stream).agg(joined_in_order(F.col(chunk), F.col(seq)).alias("_stream"))
    return whole.select(stream, decode_stream(F.col("_stream"), vendor).alias("text"))


@dataclass
class EventDecoder:
    """T1 to T3 for arriving chunks: holds the incomplete event, and for vendor 'b' the think-stripper."""

    vendor: str = "a"
    held: str = ""
    think: ThinkStripper = field(default_factory=ThinkStripper)

    def push(self, chunk: str) -> str:
        text = self.held + chunk
        tail = "\r" if text.endswith("\r") else ""  # it may be half of a line ending
        *whole, rest = text[: len(text) - len(tail)].replace("\r\n", "\n").split("\n\n")
        self.held = rest + tail
        return "".join(map(self._said, whole))

    def flush(self) -> str:
        rest, self.held = self.held, ""
        return self._said(rest) + (self.think.flush() if self.vendor == "b" else "")

    def _said(self, event: str) -> str:
        data = "".join(x[5:].strip() for x in event.split("\n") if x.startswith("data:"))
        if data in ("", "[DONE]"):
            return ""
        try:
            found = json.loads(data)
            if self.vendor == "b":
                return self.think.push((found.get("choices") or [{}])[0].get("delta", {}).get("content") or "")
            parts = ((found.get("candidates") or [{}])[0].get("content") or {}).get("parts") or []
            return "".join(p["text"] for p in parts if p.get("thought") is not True and isinstance(p.get("text"), str))
        except (ValueError, AttributeError, TypeError):
            return ""


#: Groups of streams that a live table has, where its reader names no number.
GROUPS = 4096


@dataclass
class _Stream:
    """What is kept of one live stream: the chunk whose turn it is, chunks that came before theirs, and until when it may be silent."""

    decoder: EventDecoder
    turn: int = 0
    waiting: dict[int, tuple[str, bool]] = field(default_factory=dict)
    done: bool = False
    until: int = 0

    @classmethod
    def read(cls, vendor: str, kept: list) -> _Stream:
        turn, held, think, waiting, done, until = kept
        return cls(EventDecoder(vendor, held, ThinkStripper(*think)), turn, {seq: (chunk, last) for seq, chunk, last in waiting}, done, until)

    def kept(self) -> list:
        d = self.decoder
        return [self.turn, d.held, [d.think.held, d.think.inside, d.think.fresh], [] if self.done else [(seq, *rest) for seq, rest in self.waiting.items()], self.done, self.until]

    def due(self) -> Iterator[tuple[int, str, bool]]:
        """The chunks whose turn has come, decoded."""
        while self.turn in self.waiting and not self.done:
            chunk, self.done = self.waiting.pop(self.turn)
            yield self.turn, self.decoder.push(chunk) + (self.decoder.flush() if self.done else ""), self.done
            self.turn += 1

    def ended(self) -> Iterator[tuple[int, str, bool]]:
        """What is told when it has been silent for too long: all that waits behind gaps, and the end."""
        if not self.done:
            for seq in sorted(self.waiting):
                yield seq, self.decoder.push(self.waiting[seq][0]), False
            yield max([self.turn - 1, *self.waiting]) + 1, self.decoder.flush(), True


def decode_live(chunks: DataFrame, vendor: str = "a", timeout_ms: int = 600_000, groups: int = GROUPS) -> DataFrame:
    """A streaming table of chunks (stream_id string, seq long from 0, chunk string, last boolean) as deltas (stream_id, seq, text, ended).

    Chunks may come in any order and over any number of micro-batches, and repeatedly: a stream's state holds its incomplete event, the
    think-stripper, and the chunks that came before their turn, until the gap closes. A chunk is told once, in order of seq. A
    stream that falls silent for the timeout ends: what waits behind a gap is then told without what is missing. A stream that
    has ended stays known for as long, so that repeats of its chunks don't open it again.

    Streams are dealt over so many ``groups`` by a hash, and a group's streams are one value of the state, each with a timeout of its own: a call of
    Python costs more than the chunks of many streams. A group's value is written anew whenever one of its streams has chunks, so their number is to
    follow that of the streams that are known at a time. A checkpoint keeps the number with which it began.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        now, told = state.getCurrentProcessingTimeMs(), []
        streams = {name: _Stream.read(vendor, kept) for name, kept in json.loads(state.get[0])} if state.exists else {}
        heard = set()
        if not state.hasTimedOut:
            for frame in frames:
                for name, seq, chunk, last in zip(frame["stream_id"], frame["seq"].tolist(), frame["chunk"], frame["last"], strict=True):
                    if name not in streams:
                        streams[name] = _Stream(EventDecoder(vendor))
                    heard.add(name)
                    if seq >= streams[name].turn and not streams[name].done:  # a missing number isn't
                        streams[name].waiting.setdefault(int(seq), (chunk or "", bool(last)))
        for name in heard:
            streams[name].until = now + timeout_ms
            told += [(name, *t) for t in streams[name].due()]
        for name in [name for name, stream in streams.items() if stream.until < now]:
            told += [(name, *t) for t in streams.pop(name).ended()]
        if streams:
            state.update((json.dumps([(name, stream.kept()) for name, stream in streams.items()]),))
            state.setTimeoutDuration(max(1, min(stream.until for stream in streams.values()) - now))
        else:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["stream_id", "seq", "text", "ended"])

    dealt = chunks.select(F.pmod(F.xxhash64("stream_id"), F.lit(groups)).alias("dealt"), "stream_id", "seq", "chunk", "last")
    return dealt.groupBy("dealt").applyInPandasWithState(step, "stream_id string, seq long, text string, ended boolean", "streams string", "append", "ProcessingTimeTimeout")

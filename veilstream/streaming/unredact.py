"""Putting real values back into a stream of text chunks.

A token may be split over chunks, so text that could be the start of one is held back. By default text is cut only at white
space, and never inside a token, so no emission ends inside a restored value or in the middle of a word (but for words longer
than BREAK). Parity mode cuts as the fixed rules below say and emits at once what holds no start of a token. Either way every
emission is scanned for new personal data by itself.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.functions.patterns import EGRESS, LUHN_LENGTHS, PATTERNS
from veilstream.operators.redact import DIGIT_MARKS, MARK, REDACTED, STOP, token_spans, unmask_exact
from veilstream.session import ship_package

#: A held prefix longer than BREAK gives all but its last BACKOFF characters.
BREAK = 100
BACKOFF = 50
#: Chunks of a response that wait for an earlier one, at most; beyond that the earliest of them goes on.
REORDER = 1024

_compiled = {c: re.compile(PATTERNS[c], re.IGNORECASE if c == "EMAIL" else 0) for c in PATTERNS}


def luhn_ok(number: str) -> bool:
    digits = [int(c) for c in number if c in "0123456789"]
    if not LUHN_LENGTHS[0] <= len(digits) <= LUHN_LENGTHS[1]:
        return False
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def egress_text(text: str) -> str:
    for category in EGRESS:
        put = (lambda m: REDACTED if luhn_ok(m[0]) else m[0]) if category == "CC" else REDACTED
        text = _compiled[category].sub(put, text)
    return text


class Unredactor:
    """One response's state: the text held back (in parity mode with its tokens already replaced, else as it came)."""

    def __init__(self, subs: list[tuple[str, str]], buffer: str = "", parity: bool = False):
        self.subs = [(t, r) for t, r in subs if t]
        self.longest = max((len(t) for t, _ in self.subs), default=0)
        self.buffer, self.parity = buffer, parity

    def _held_from(self, least: int = 0) -> int:
        """Where the earliest suffix (from ``least`` on) starts that begins a token."""
        text = self.buffer
        for at in range(max(least, len(text) - self.longest), len(text)):
            if any(t.startswith(text[at:]) for t, _ in self.subs):
                return at
        return len(text)

    def _emit(self, text: str) -> str:
        marks = {r: MARK + str(i).translate(str.maketrans("0123456789", DIGIT_MARKS)) + STOP for i, r in enumerate(dict.fromkeys(r for _, r in self.subs)) if r}
        for real, mark in marks.items():
            text = text.replace(real, mark)
        text = egress_text(text)
        for real, mark in marks.items():
            text = text.replace(mark, real)
        return text

    def _cut(self, end: int, spans: list[tuple[int, int, str]]) -> int:
        """The last place up to ``end`` that follows white space and lies in no token; 0 if all has to wait."""
        inside = [(a, b) for a, b, _ in spans]
        for at in range(end, 0, -1):
            if self.buffer[at - 1].isspace() and not any(a < at < b for a, b in inside):
                return at
        if end <= BREAK:
            return 0
        at = end - BACKOFF
        return next((a for a, b in inside if a < at < b), at)

    def process(self, chunk: str) -> str:
        if self.parity:
            return self._process_parity(chunk)
        self.buffer += chunk
        spans = token_spans(self.buffer, [t for t, _ in self.subs])
        cut = self._cut(self._held_from(spans[-1][1] if spans else 0), spans)
        out, self.buffer = self.buffer[:cut], self.buffer[cut:]
        return self._emit(unmask_exact(out, self.subs)) if out else ""

    def _process_parity(self, chunk: str) -> str:
        self.buffer = unmask_exact(self.buffer + chunk, self.subs)
        safe = self._held_from()
        if 0 < safe < len(self.buffer):
            spaces = [i for i, c in enumerate(self.buffer[:safe]) if c.isspace()]
            if spaces:
                safe = spaces[-1] + 1
            elif safe > BREAK:
                safe -= BACKOFF
            else:
                return ""
        out, self.buffer = self.buffer[:safe], self.buffer[safe:]
        return self._emit(out) if out else ""

    def flush(self) -> str:
        out, self.buffer = self.buffer, ""
        if not self.parity:
            out = unmask_exact(out, self.subs)
        return self._emit(out) if out else ""


def unredact_batch(chunks: DataFrame, parity: bool = False) -> DataFrame:
    """response_id, seq, emitted, flushed (on the last row of a response) of chunks (response_id, seq, chunk, subs).

    ``subs`` is an array of structs with synthetic and real; other fields are not read. Rows are sorted within partitions and streamed, so a response may be of any length.
    """
    ship_package(chunks.sparkSession)
    rows = chunks.select(F.col("response_id").cast("long"), F.col("seq").cast("long"), F.coalesce("chunk", F.lit("")).alias("chunk"), F.transform("subs", lambda s: F.struct(s["synthetic"].alias("synthetic"), s["real"].alias("real"))).alias("subs"))
    dealt = rows.repartition("response_id").sortWithinPartitions("response_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]):
        key, state, last = None, None, None
        names = ["response_id", "seq", "emitted", "flushed"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            out = []
            for rid, seq, chunk, pairs in zip(*[c.to_pylist() for c in batch.columns]):
                if last is not None:
                    out.append((*last, state.flush() if rid != key else None))
                if rid != key or state is None:
                    key, state = rid, Unredactor([(p["synthetic"], p["real"]) for p in pairs or []], parity=parity)
                last = (rid, seq, state.process(chunk))
            if out:
                yield batch_of(out)
        if last is not None:
            yield batch_of([(*last, state.flush())])

    return dealt.mapInArrow(run, "response_id long, seq long, emitted string, flushed string")


def unredact_stream(chunks: DataFrame, timeout: str = "1 hour", parity: bool = False, reorder: int = REORDER) -> DataFrame:
    """Structured Streaming twin: chunks (response_id, seq, chunk, subs, is_last) to (response_id, seq, emitted).

    ``seq`` counts 0, 1, 2, ... in a response. Chunks are taken one by one as they come; one that comes before its turn waits in
    the state, with at most ``reorder`` others. One that comes after its turn is taken at once. The state is the text held back
    and the chunks that wait. A response whose last chunk never comes is flushed when it times out: by processing time, which
    the engine looks at in every batch, also those without data (``spark.sql.streaming.noDataMicroBatches.enabled``). Where
    those are off, a time-out fires with the next data; where they are on, the query needs a trigger interval, or it runs batch after batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship_package(chunks.sparkSession)
    millis = int(timeout.split()[0]) * {"hour": 3_600_000, "minute": 60_000, "second": 1000}[timeout.split()[1].rstrip("s")]
    names = ["response_id", "seq", "emitted"]

    def step(key, frames, state: GroupState):
        buffer, pairs, due, waiting = state.get if state.exists else ("", "[]", 0, "[]")
        work = Unredactor([tuple(p) for p in json.loads(pairs)], buffer, parity)
        heap = [tuple(x) for x in json.loads(waiting)]
        if state.hasTimedOut:
            out = []
            while heap:
                due, text, _ = heapq.heappop(heap)
                out.append((key[0], due, work.process(text)))
            out.append((key[0], due, work.flush()))
            state.remove()
            yield pd.DataFrame(out, columns=names)
            return
        done = False
        for frame in frames:
            out = []
            for row in frame.itertuples():
                if row.subs is not None and len(row.subs) and not work.subs:
                    work = Unredactor([(p["synthetic"], p["real"]) for p in row.subs], work.buffer, parity)
                heapq.heappush(heap, (int(row.seq), row.chunk or "", bool(row.is_last)))
                while heap and (heap[0][0] <= due or len(heap) > reorder):
                    seq, text, last = heapq.heappop(heap)
                    due = max(due, seq + 1)
                    text = work.process(text)
                    if last:
                        text, done = text + work.flush(), True
                    out.append((key[0], seq, text))
            yield pd.DataFrame(out, columns=names)
        if done and not heap:
            state.remove()
        else:
            state.update((work.buffer, json.dumps(work.subs), due, json.dumps(heap)))
            state.setTimeoutDuration(millis)

    return chunks.groupBy("response_id").applyInPandasWithState(
        step, "response_id long, seq long, emitted string", "buffer string, pairs string, due long, waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )

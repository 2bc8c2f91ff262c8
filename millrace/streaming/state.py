"""The same features a second way: keyed state, one event at a time.

Nothing here shares window logic with the batch operators, so that agreement means something.
Under the policy "watermark" an event waits until a strictly newer one of its card arrives (or
the card is idle for a while), so ties never see each other; under "arrival" it counts at once."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.spec import FEATURE_NAMES, FEATURES, NO_LAST, PRODUCTS, WINDOWS
from millrace.workers import reach

POLICIES = ("watermark", "arrival")
LONGEST = max(WINDOWS.values())


class Trailing:
    """Sum and maximum of the events of a sorted list that lie after a moving start, without subtraction.

    Events before `mid` have their totals up to `mid` in a stack; those behind it have one running
    total.  When the start passes `mid`, the stack is made again, so each event is added twice at most."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.start = self.mid = self.end = 0
        self.sums: list[float] = []
        self.tops: list[float] = []
        self.sum, self.top = 0.0, 0.0

    def at(self, now: int, times: list[int], amounts: list[float]) -> tuple[int, float, float]:
        """Count, sum and maximum of what is after now - length; `now` never falls between two calls of clear."""
        for i in range(self.end, len(times)):
            amount = amounts[i]
            self.top = amount if self.end == self.mid or amount > self.top else self.top
            self.sum += amount
            self.end += 1
        begin, start = now - self.length, self.start
        while start < self.end and times[start] <= begin:
            start += 1
        self.start = start
        if start > self.mid or (start == self.mid and self.mid < self.end and not self.sums):
            self._stack(amounts)
        if start == self.end:
            return 0, 0.0, 0.0
        if start == self.mid:
            return self.end - start, self.sum, self.top
        sums, tops = self.sums[start - self.mid], self.tops[start - self.mid]
        return self.end - start, sums + self.sum, max(tops, self.top) if self.end > self.mid else tops

    def _stack(self, amounts: list[float]) -> None:
        """Totals from each event to the end; the last of the lists is that of the newest."""
        self.sums, self.tops = [], []
        total, top = 0.0, float("-inf")
        for i in range(self.end - 1, self.start - 1, -1):
            total += amounts[i]
            top = max(top, amounts[i])
            self.sums.append(total)
            self.tops.append(top)
        self.sums.reverse()
        self.tops.reverse()
        # indices from the end: sums[start - mid] counts back from there
        self.mid = self.end
        self.sum, self.top = 0.0, 0.0


class CardState:
    """Retained events of one card in time order, those that still wait, and the totals that outlive the windows.

    Events that come in time order cost a few steps each; a late one is put in its place and the
    running totals are made again."""

    def __init__(self, kept=(), waiting=(), last: int | None = None, born: int = 0, late: int = 0):
        held = sorted(kept)
        self.times = [e[0] for e in held]
        self.amounts = [e[1] for e in held]
        self.codes = [e[2] for e in held]
        self.waiting: list[tuple[int, float, str]] = list(waiting)
        self.newest = max([t for t, *_ in self.waiting] + ([last] if last is not None else []), default=None)
        self.last, self.born, self.late = last, born, late
        self.moved: int | None = None
        self.trailing = {name: Trailing(length) for name, length in WINDOWS.items()}
        self.products = dict.fromkeys(PRODUCTS, 0)
        self.counted = self.left = 0

    @property
    def kept(self) -> list[tuple[int, float, str]]:
        return list(zip(self.times, self.amounts, self.codes, strict=True))

    def _again(self) -> None:
        """Forget running totals, as the past has changed or is asked about."""
        for t in self.trailing.values():
            t.clear()
        self.products = dict.fromkeys(PRODUCTS, 0)
        self.counted = self.left = 0
        self.moved = None

    def fold(self, before: int | None = None) -> None:
        """Commit what waits: all of it, or what is strictly older than `before`."""
        if not self.waiting:
            return
        ready = [e for e in self.waiting if before is None or e[0] < before]
        if ready:
            self.waiting = [e for e in self.waiting if before is not None and e[0] >= before]
            for event in ready:
                self.commit(event)

    def commit(self, event: tuple[int, float, str]) -> None:
        u, amount, code = event
        if self.times and u < self.times[-1]:
            i = bisect_right(self.times, u)
            self._again()
        else:
            i = len(self.times)
        self.times.insert(i, u)
        self.amounts.insert(i, amount)
        self.codes.insert(i, code)
        self.last = u if self.last is None else max(self.last, u)
        self.newest = u if self.newest is None else max(self.newest, u)
        self.born += 1

    def features(self, now: int, closed: bool) -> list[float]:
        """Values at `now`; closed: events at `now` itself count (a store view, or the policy "arrival")."""
        if self.times and (self.times[-1] > now or (not closed and self.times[-1] == now)):
            return self._past(now, closed)
        if self.moved is not None and now < self.moved:
            self._again()
        self.moved = now
        made: dict[str, float] = {}
        for name, window in self.trailing.items():
            n, total, top = window.at(now, self.times, self.amounts)
            made[f"txn_count_{name}"], made[f"amt_sum_{name}"], made[f"amt_max_{name}"] = n, total, top
            made[f"amt_mean_{name}"] = total / n if n else 0.0
            if window.length == LONGEST:
                for i in range(self.counted, len(self.times)):
                    self.products[self.codes[i]] += 1
                for i in range(self.left, window.start):
                    self.products[self.codes[i]] -= 1
                self.counted, self.left = len(self.times), window.start
                made |= {f"product_{p}_count_7d": c for p, c in self.products.items()}
        return self._row(made)

    def _past(self, now: int, closed: bool) -> list[float]:
        """Values at a time before the newest committed event."""
        end = (bisect_right if closed else bisect_left)(self.times, now)
        made: dict[str, float] = {}
        for name, length in WINDOWS.items():
            begin = bisect_right(self.times, now - length)
            amounts = self.amounts[begin:end]
            total = sum(amounts)
            made[f"txn_count_{name}"], made[f"amt_sum_{name}"], made[f"amt_max_{name}"] = len(amounts), total, max(amounts, default=0.0)
            made[f"amt_mean_{name}"] = total / len(amounts) if amounts else 0.0
            if length == LONGEST:
                codes = self.codes[begin:end]
                made |= {f"product_{p}_count_7d": codes.count(p) for p in PRODUCTS}
        return self._row(made)

    def _row(self, made: dict[str, float]) -> list[float]:
        made["last_txn_unixtime"] = NO_LAST if self.last is None else float(self.last)
        made["txn_count_lifetime"] = self.born
        return [made[n] for n in FEATURE_NAMES]

    def see(self, u: int, amount: float, code: str, policy: str) -> list[float]:
        """The features as of just before the event, which is then taken in."""
        self.late += self.newest is not None and u < self.newest
        code = code if code in PRODUCTS else PRODUCTS[0]
        if policy == "watermark":
            self.fold(u)
        found = self.features(u, policy == "arrival")
        if policy == "watermark":
            self.waiting.append((u, amount, code))
            self.newest = u if self.newest is None else max(self.newest, u)
        else:
            self.commit((u, amount, code))
        return found

    def trim(self) -> None:
        """Drop what no window of a later event can reach."""
        if self.last is not None:
            n = bisect_right(self.times, self.last - LONGEST)
            if n:
                del self.times[:n], self.amounts[:n], self.codes[:n]
                self._again()


OUTPUT = T.StructType(
    [
        T.StructField("card_id", T.StringType()),
        T.StructField("view", T.StringType()),
        T.StructField("transaction_id", T.LongType()),
        T.StructField("u", T.LongType()),
        T.StructField("late", T.LongType()),
        *[T.StructField(f.name, f.spark_type) for f in FEATURES],
    ]
)
_EVENT = T.StructType([T.StructField("u", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("code", T.StringType())])
_TOTALS = T.StructType([T.StructField("last", T.LongType()), T.StructField("born", T.LongType()), T.StructField("late", T.LongType())])


class CardProcessor(StatefulProcessor):
    """One scoring row for each event, and one store row for each card that changed (if anything is committed).

    With release_ms, what waits for so long without a newer event is committed by a timer, and the
    card's row comes with the view "released"."""

    def __init__(self, policy: str = "watermark", finalize: bool = False, release_ms: int | None = None):
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}")
        self.policy, self.finalize, self.release_ms = policy, finalize, release_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", _EVENT)
        self.waiting = handle.getListState("waiting", _EVENT)
        self.totals = handle.getValueState("totals", _TOTALS)

    def _load(self) -> CardState:
        last, born, late = self.totals.get() if self.totals.exists() else (None, 0, 0)
        held = [[tuple(e) for e in s.get()] if s.exists() else [] for s in (self.kept, self.waiting)]
        return CardState(held[0], held[1], last, born, late)

    def _save(self, card: CardState) -> None:
        card.trim()
        for state, events in ((self.kept, card.kept), (self.waiting, card.waiting)):
            if events:
                state.put(events)
            else:
                state.clear()
        self.totals.update((card.last, card.born, card.late))

    def _store_rows(self, key, card: CardState, view: str = "store") -> list[list]:
        return [[key[0], view, None, card.last, card.late, *card.features(card.last, True)]] if card.last is not None else []

    @staticmethod
    def _frame(rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=OUTPUT.names).astype({"transaction_id": "Int64", "u": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key's rows may come in several chunks and in any order: gather, then sort by arrival
        columns = ("arrival", "u", "transaction_id", "amount", "product_cd")
        events = sorted(e for chunk in rows for e in zip(*(chunk[c].tolist() for c in columns), strict=True))
        card, out = self._load(), []
        for _, u, ident, amount, code in events:
            found = card.see(u, amount, code, self.policy)
            out.append([key[0], "scoring", ident, u, card.late, *found])
        if self.finalize:
            card.fold()
        elif self.release_ms is not None and card.waiting:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.release_ms)
        out += self._store_rows(key, card)
        self._save(card)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        card = self._load()
        card.fold()
        out = self._store_rows(key, card, "released")
        self._save(card)
        yield self._frame(out)

    def close(self) -> None:
        pass


#: events of a card after which a replay drops what no window can reach, and rows of one output batch
TRIM_EVENTS = 10_000
OUTPUT_ROWS = 20_000


def _replay(policy: str, finalize: bool):
    """Rows sorted by card and arrival to the rows that the processor gives, without a state store: a card's state lives while its rows pass."""
    kinds = [{T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}[f.dataType] for f in OUTPUT.fields]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=OUTPUT.names)

    def ended(name: str, card: CardState) -> list[tuple]:
        if finalize:
            card.fold()
        return [(name, "store", None, card.last, card.late, *card.features(card.last, True))] if card.last is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, card, n = None, None, 0
        for batch in batches:
            for name, u, ident, amount, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if card is None or name != now:
                    if card is not None:
                        rows += ended(now, card)
                    now, card, n = name, CardState(), 0
                found = card.see(u, amount, code, policy)
                rows.append((name, "scoring", ident, u, card.late, *found))
                n += 1
                if n % TRIM_EVENTS == 0:
                    card.trim()
                if len(rows) >= OUTPUT_ROWS:
                    yield frame(rows)
                    rows = []
        if card is not None:
            rows += ended(now, card)
        if rows:
            yield frame(rows)

    return run


def keyed_features(events: DataFrame, policy: str = "watermark", finalize: bool = False, release_ms: int | None = None) -> DataFrame:
    """Scoring and store rows of a stream or a batch with (card_id, u, transaction_id, amount, product_cd).

    Rows of a card are taken in the order of the column `arrival` if there is one (an offset, say), and
    late ones are counted by it; without it a batch is taken in the order of time."""
    reach(events.sparkSession)
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    arrival = F.col("arrival").cast("long") if "arrival" in events.columns else F.lit(0).cast("long")
    rows = events.select("card_id", arrival.alias("arrival"), "u", "transaction_id", F.col("amount").cast("double").alias("amount"), "product_cd")
    if not events.isStreaming:
        # a batch is replayed card by card, with the same state machine
        ordered = rows.repartition("card_id").sortWithinPartitions("card_id", "arrival", "u", "transaction_id", "amount", "product_cd")
        return ordered.drop("arrival").mapInArrow(_replay(policy, finalize), OUTPUT)
    mode = "ProcessingTime" if release_ms is not None else "None"
    processor = CardProcessor(policy, finalize, release_ms)
    return rows.groupBy("card_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode=mode)

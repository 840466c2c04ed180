"""Operator 2, best-fit packing: a configuration linear program over the length histogram.

Texts become token ids (a distinct-chunk table, see chunk_table), only documents longer than a sequence are cut. The
histogram of piece lengths has at most ``capacity`` bins whatever the corpus, so the rest of the plan is made on the driver:
multiplicative weights price lengths, a knapsack dynamic program finds the best configurations under those prices, full or
not, their use is averaged into a fractional solution, that is rounded, and what is left is placed by best fit, for whole
groups of alike sequences at a time; this goes on until the plan is near the program's lower bound and no longer than best
fit's own. The plan is a table of at most a few thousand
configurations; each piece finds its sequence and offset from its rank among pieces of its length, a rank taken in salted
groups, so that one length may hold any share of the rows.

Defined results: null text is empty and still gives one piece (the end id); repeated rows are packed each; ties of equal
length are ordered by doc_id, piece and content; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_table import BytePairTable, groups, table
from .common import cut, shuffles, tidy


def tokenizer_paths() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, paths: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. All but a document's first piece are full."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        codec = table(BytePairTable, *(paths or tokenizer_paths()))
        for batch in batches:
            row, nth, start, length, crc = [], [], [], [], []
            for begin, texts in groups(batch.column(1).to_pylist()):
                for i, ids in enumerate(codec.encode(texts), begin):
                    ids += end
                    n = len(ids) // 4
                    count = -(-n // capacity)
                    at, size = 0, n - capacity * (count - 1)
                    for k in range(count):
                        row.append(i)
                        nth.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run, keeps=True), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _values(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack's dynamic program: the best value of each room, and the length it takes (0: leave one token free)."""
    value = np.full(capacity + 1, -np.inf)
    value[lengths] = prices[lengths]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = best[c - 1 :: -1] + value[1 : c + 1]
        at = int(total.argmax())
        best[c], choice[c] = (total[at], at + 1) if total[at] > best[c - 1] else (best[c - 1], 0)
    return best, choice


def _choose(first: int, choice: list[int], have: list[int], capacity: int) -> dict[int, int]:
    """The best configuration with a piece of length first; it has at most have[l] pieces of length l."""
    got, c = {first: 1}, capacity - first
    while c > 0:
        length = choice[c]
        if length and got.get(length, 0) < have[length]:
            got[length] = got.get(length, 0) + 1
            c -= length
        else:
            c -= 1
    return got


def covering(demand: np.ndarray, capacity: int, rounds: int = 300, step: float = 0.25, rate: float = 0.25, near: float = 0.002) -> Iterator[tuple[dict[tuple, float], float]]:
    """The covering linear program by multiplicative weights: now and then, configurations with their use, and a lower bound.

    A round prices all lengths, solves one knapsack, and uses configurations whose value is within `near` of the best, one
    for each length that has any, until a length is covered by `step`; covered lengths get cheaper at `rate`. The prices over
    the best value are feasible duals, so they bound the program from below. A length that is covered whole costs nothing
    more; when all are, the solution is handed on, and another begins, where lengths that were covered late start dearer.
    """
    lengths = np.flatnonzero(demand)
    have = demand.tolist()
    log_price, bound = np.log(lengths / capacity), 0.0  # a length's price starts as its share of a sequence
    covered, use, seen, begun = np.zeros(capacity + 1), {}, np.zeros(len(lengths)), 0
    for k in range(1, rounds + 1):
        prices = np.zeros(capacity + 1)
        prices[lengths] = np.exp(log_price - rate * covered[lengths])
        prices[covered > 1 - 1e-9] = 0
        best, choice = _values(prices, np.flatnonzero(prices), capacity)
        bound = max(bound, float(demand @ prices) / best[capacity])
        worth, turns = prices[lengths] + best[capacity - lengths], choice.tolist()
        room, any_ = np.minimum(step, 1 - covered).tolist(), False
        for i in np.argsort(-worth, kind="stable").tolist():
            length = int(lengths[i])
            if worth[i] < (1 - near) * best[capacity] and any_:
                break
            if not prices[length] or room[length] < min(step / 2, 1 - covered[length]):
                continue
            config = _choose(length, turns, have, capacity)
            if any_ and sum(prices[x] * n for x, n in config.items()) < (1 - near) * best[capacity]:
                continue
            amount = min(room[x] * have[x] / n for x, n in config.items())
            if amount > 0:
                key = tuple(sorted(config.items()))
                use[key], any_ = use.get(key, 0.0) + amount, True
                for x, n in config.items():
                    room[x] -= amount * n / have[x]
                    covered[x] += amount * n / have[x]
        seen += covered[lengths]
        if covered[lengths].min() > 1 - 1e-9:
            yield use, bound
            log_price = log_price - rate * seen / (k - begun)
            covered, use, seen, begun = np.zeros(capacity + 1), {}, np.zeros(len(lengths)), k
    if use:
        yield use, bound


def plan(histogram: np.ndarray, capacity: int, rounds: int = 300, gap: float = 0.0005) -> list[tuple[int, dict[int, int]]]:
    """Configurations and how many sequences use each: together they hold exactly the histogram (index: length).

    rounds: knapsacks solved at most; gap: the program ends when the plan has at most this share, or one sequence, more than
    the program's lower bound, and no more than best fit alone. Its best plan is taken, unless best fit alone has fewer
    sequences after all rounds.
    """
    left = histogram.astype(np.int64).copy()
    full = [(int(left[capacity]), {capacity: 1})] if left[capacity] else []
    left[capacity] = 0
    if not left.any():
        return full
    fit, best = _best_fit(left.copy(), capacity), None
    for fractional, bound in covering(left, capacity, rounds):
        made = _rounded(fractional, left, capacity, _sequences(fit))
        if best is None or _sequences(made) < _sequences(best):
            best = made
        least = np.ceil(bound - 1e-6)
        if _sequences(best) <= min(_sequences(fit), least + max(1, gap * least)):
            break
    return full + (best if best is not None and _sequences(best) <= _sequences(fit) else fit)


def _sequences(made: list[tuple[int, dict[int, int]]]) -> int:
    return sum(times for times, _ in made)


def _rounded(fractional: dict[tuple, float], histogram: np.ndarray, capacity: int, enough: int = 0) -> list[tuple[int, dict[int, int]]]:
    """A whole plan from a fractional one: rounded down, then one more each where the pieces are there, and best fit for what is
    left. Pieces that rounding leaves are few and alike, which wastes a sequence or two; so, until the plan has at most
    `enough` sequences, configurations with slack and a larger part of the others' use are left to best fit."""
    best = None
    for kept in (1.0, 0.98, 0.95, 0.9, 0.8, 0.6) if fractional else (1.0,):
        left = histogram.copy()
        used = {key: amount * kept for key, amount in fractional.items() if kept == 1 or sum(x * n for x, n in key) == capacity}
        made = _taken(used, left, kept == 1) + _best_fit(left, capacity)
        if best is None or _sequences(made) < _sequences(best):
            best = made
        if _sequences(best) <= enough:
            break
    return best


def _taken(fractional: dict[tuple, float], left: np.ndarray, up: bool = True) -> list[tuple[int, dict[int, int]]]:
    """Configurations as often as the fractional solution uses them, as far as the pieces go, which leave the histogram. up:
    then each once more."""
    result = []
    for whole in (True, False) if up else (True,):
        for key, amount in sorted(fractional.items(), key=lambda x: (-(x[1] % 1), x[0])):
            times = min(int(amount + 1e-9) if whole else 1, *(int(left[length]) // n for length, n in key))
            if times > 0:
                result.append((times, dict(key)))
                for length, n in key:
                    left[length] -= times * n
    return result


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Longest first, for whole groups of sequences that are alike."""
    spare: dict[int, list[list]] = {}  # room left: groups of (sequences, configuration)
    rooms: list[int] = []
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, config = spare[room].pop()
                if not spare[room]:
                    del spare[room], rooms[at]
                used = min(n, times)
                if times > used:
                    _put(spare, rooms, room, times - used, config)
            else:
                room, used, config = capacity, -(-n // (capacity // length)), {}
                used = used if capacity // length > 1 else n
            config = config | {length: config.get(length, 0) + 1}
            _put(spare, rooms, room - length, used, config)
            n -= used
    return [(times, config) for groups_ in spare.values() for times, config in groups_]


def _put(spare: dict[int, list[list]], rooms: list[int], room: int, times: int, config: dict[int, int]) -> None:
    if room not in spare:
        spare[room] = []
        bisect.insort(rooms, room)
    spare[room].append([times, config])


def _slots(chosen: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and configuration: the first rank that it takes, copies in a sequence, first sequence, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, config in chosen:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            rows.append((length, taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + times * n
            offset += length * n
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "copies", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, paths: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = cut(pieces(docs, capacity, end_id, paths, id_col, text_col))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    slots = _slots(plan(histogram, capacity))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(max(16, shuffles(docs))))  # found lies in files: its partitions are fixed
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = found.withColumn("salt", salt)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(group)).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    def place(batches):
        order = slots["length"] * (1 << 44) + slots["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(order, length * (1 << 44) + rank, "right") - 1
            turn, copy = np.divmod(rank - slots["first"][k], slots["copies"][k])
            put = [slots["sequence"][k] + turn, slots["offset"][k] + copy * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(x.astype(np.int64)) for x in put]], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

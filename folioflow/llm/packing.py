"""Problem 4: filling fixed-capacity containers with items.

A request is a window. Its units wait in source queues (the pages they come
from); deficit round-robin gives each queue the share of the window that its
tokens have of the call, and what a queue got too much or too little is
carried to the next window. Within a queue the largest unit that still fits
goes first. Where that would take more requests than best fit or exact subset
sums over all units, the units move as those have them: filling comes before
proportions.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.arrow import map_rows


def divide(tokens: int, capacity: int) -> list[int]:
    """Equal parts, as few as the capacity allows."""
    n = -(-tokens // capacity)
    return [tokens * (i + 1) // n - tokens * i // n for i in range(n)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of items by container: largest first, each into the fullest container with room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (left - sizes[i], b))
    return bins


def round_robin(sizes: list[int], queues: list[str], capacity: int, deficit: dict[str, float] | None = None, share: dict[str, float] | None = None) -> list[list[int]]:
    """Indexes of items by container, mixing the queues in the proportions ``share``, or those of their tokens.

    ``deficit`` is carried in and out: tokens a queue is owed.
    """
    owed = deficit if deficit is not None else {}
    waiting: dict[str, list[tuple[int, int]]] = {}
    for i, q in enumerate(queues):
        waiting.setdefault(q, []).append((sizes[i], -i))
    for w in waiting.values():
        w.sort()
    total = sum(sizes) or 1
    quantum = {q: capacity * (sum(s for s, _ in w) / total if share is None else share.get(q, 0.0)) for q, w in waiting.items()}
    out: list[list[int]] = []
    while waiting:
        room, got = capacity, []
        for q in waiting:
            owed[q] = owed.get(q, 0.0) + quantum[q]
        while True:
            # the queue owed most among those with an item that fits
            best = None
            for q in sorted(waiting, key=lambda q: (-owed[q], q)):
                at = bisect_left(waiting[q], (room, 1)) - 1
                if at >= 0:
                    best = (q, at)
                    break
            if best is None:
                break
            q, at = best
            size, i = waiting[q].pop(at)
            if not waiting[q]:
                del waiting[q]
            owed[q] -= size
            room -= size
            got.append(-i)
        out.append(got)
    return out


def fullest_first(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of items by container: each holds the largest item left and the subset of the others that fills it most.

    Subset sums run over the different sizes left, each as often as it may fit,
    so a container costs at most ``capacity`` sizes however many items wait.
    """
    waiting: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -i):
        waiting.setdefault(sizes[i], []).append(i)
    order = sorted(waiting)
    free = waiting.pop(0, [])  # empty items go into the first container
    out: list[list[int]] = []
    while order and order[-1] > 0:
        first = order[-1]
        got, room = [waiting[first].pop()], capacity - first
        mask = (1 << (room + 1)) - 1
        sums, steps = [1], []  # bit s: the sizes so far have a subset of sum s
        for s in order[bisect_left(order, 1) : bisect_left(order, room + 1)]:
            many, k = min(len(waiting[s]), room // s), 1
            while many > 0:
                take = min(k, many)
                steps.append((s, take))
                sums.append((sums[-1] | sums[-1] << s * take) & mask)
                many -= take
                k *= 2
        left = sums[-1].bit_length() - 1
        for j in range(len(steps), 0, -1):
            if not sums[j - 1] >> left & 1:
                s, take = steps[j - 1]
                got += [waiting[s].pop() for _ in range(take)]
                left -= s * take
        out.append(sorted(got + free))
        free = []
        order = [s for s in order if waiting.get(s)]
    if free:
        out.append(sorted(free))
    return out


def pack(sizes: list[int], queues: list[str], capacity: int, deficit: dict[str, float] | None = None) -> list[list[int]]:
    """Containers of one call; every size is at most the capacity."""
    mixed = round_robin(sizes, queues, capacity, deficit)
    floor = -(-sum(sizes) // capacity)
    if len(mixed) <= floor:
        return mixed
    tight = best_fit(sizes, capacity)
    if min(len(mixed), len(tight)) > floor:
        tight = min(tight, fullest_first(sizes, capacity), key=len)
    return mixed if len(mixed) <= len(tight) else tight


def pack_calls(calls: DataFrame) -> DataFrame:
    """Units of each call, assigned to requests of at most max_output_tokens.

    calls: call_id, units array<struct<id, text, tokens>>, max_output_tokens;
    other columns are ignored. One row per unit and part: request_no (from 0),
    unit_id, part_no, n_parts, tokens (of the part), oversized, capacity.
    A unit is divided only if it alone exceeds the capacity. Units listed
    twice and repeated calls come once. A null or non-positive capacity leaves
    all units in request 0, undivided; null units, ids and negative tokens
    give no row. A call is one array, so its packing needs no shuffle of
    units; repeated calls cost one shuffle.
    """
    once = calls.where("call_id IS NOT NULL AND units IS NOT NULL").select(
        "call_id",
        F.transform("units", lambda u: F.struct(u["id"].alias("id"), u["tokens"].alias("tokens"))).alias("u"),
        F.col("max_output_tokens").alias("capacity"),
    )
    once = once.dropDuplicates(["call_id"])

    def make():
        def kernel(call, units, capacity):
            out = [[] for _ in range(8)]

            def emit(*row):
                for col, v in zip(out, row):
                    col.append(v)

            for c, us, cap in zip(call, units, capacity):
                seen: dict[str, int] = {}
                for u in us:
                    if u and u["id"] is not None and u["tokens"] is not None and u["tokens"] >= 0:
                        seen[u["id"]] = max(u["tokens"], seen.get(u["id"], 0))
                if not cap or cap <= 0:
                    for i, t in seen.items():
                        emit(c, 0, i, 0, 1, t, False, cap)
                    continue
                parts = [(i, k, n, s, n > 1) for i, t in seen.items() for n, cuts in [(max(1, -(-t // cap)), divide(t, cap) if t > cap else [t])] for k, s in enumerate(cuts)]
                for r, bin_ in enumerate(pack([p[3] for p in parts], [_source(p[0]) for p in parts], cap)):
                    for j in sorted(bin_):
                        i, k, n, s, big = parts[j]
                        emit(c, r, i, k, n, s, big, cap)
            return out

        return kernel

    return map_rows(once, "call_id string, request_no int, unit_id string, part_no int, n_parts int, tokens int, oversized boolean, capacity int", make)


#: Tokens of a part of the corpus that one task packs.
PART_TOKENS = 20_000_000


def mix_windows(items: DataFrame, capacity: int, targets: dict[str, float] | None = None, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Items of all sources, packed into windows of ``capacity`` tokens that hold target proportions of the sources.

    items: item_id, source, tokens. Result: window_id, item_id, piece_no,
    source, tokens. Deficit round-robin over the source queues: each window
    adds capacity times its proportion to what a queue is owed, and a queue
    owed most goes first. What is owed is carried from window to window and
    from part to part: parts are dealt out by a hash of the items, a part
    begins with what the parts before it owe by their sums, so no queue is
    gathered. targets defaults to the sources' shares of all tokens; sources
    without a target wait for room that no other can fill. An item larger than
    the capacity is divided, no other is. Null ids, null sources and null or
    negative tokens give no row, repeated rows of an item come once (the
    largest), empty tables give no row.
    """
    once = items.where("item_id IS NOT NULL AND source IS NOT NULL AND tokens >= 0").groupBy("item_id").agg(F.max(F.struct(F.col("tokens").cast("bigint").alias("tokens"), "source")).alias("x")).select("item_id", "x.source", "x.tokens")
    total = once.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    dealt = once.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    sums = dealt.groupBy("part", "source").agg(F.sum("tokens").alias("n"))
    whole = sums.groupBy("source").agg((F.sum("n") / F.lit(float(total or 1))).alias("share"))
    if targets is not None:
        scale = sum(targets.values()) or 1.0
        whole = whole.select("source", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, v / scale)]) if targets else F.lit(None).cast("map<string,double>"), F.col("source")), F.lit(0.0)).alias("share"))
    # parts x sources rows: what each part begins with
    grid = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(sums, ["part", "source"], "left").fillna(0, ["n"])
    size = Window.partitionBy("part")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    owed = grid.withColumn("all", F.sum("n").over(size)).select("part", "source", "share", F.coalesce(F.sum(F.col("share") * F.col("all") - F.col("n")).over(before), F.lit(0.0)).alias("owed"))

    def fill(key, got, begin):
        import pyarrow as pa

        part = key[0].as_py()
        rows, queues = got.to_pydict(), begin.to_pylist()
        pieces = sorted((i, k, q, s) for i, q, t in zip(rows["item_id"], rows["source"], rows["tokens"]) for k, s in enumerate(divide(t, capacity) if t > capacity else [t]))
        deficit = {q["queue"]: q["owed"] for q in queues}
        share = {q["queue"]: q["share"] for q in queues}
        bins = round_robin([p[3] for p in pieces], [p[2] for p in pieces], capacity, deficit, share)
        out = [(f"{part}_{w}", *pieces[j]) for w, b in enumerate(bins) for j in sorted(b)]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table({"window_id": pa.array(cols[0], pa.string()), "item_id": pa.array(cols[1], pa.string()), "piece_no": pa.array(cols[2], pa.int32()), "source": pa.array(cols[3], pa.string()), "tokens": pa.array(cols[4], pa.int64())})

    return dealt.groupBy("part").cogroup(owed.toDF("of_part", "queue", "share", "owed").groupBy("of_part")).applyInArrow(fill, "window_id string, item_id string, piece_no int, source string, tokens bigint")


def fill_report(requests: DataFrame) -> DataFrame:
    """(call_id, requests, least, unused, unused_least): requests of pack_calls() by call, against the bound that tokens and capacity set."""
    r = requests.where("capacity > 0").groupBy("call_id", "capacity").agg(F.countDistinct("request_no").cast("bigint").alias("requests"), F.sum("tokens").cast("bigint").alias("n"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity"))).cast("bigint")
    return r.select("call_id", "requests", least.alias("least"), (F.col("requests") * F.col("capacity") - F.col("n")).alias("unused"), (least * F.col("capacity") - F.col("n")).alias("unused_least"))


def _source(unit_id: str) -> str:
    """The queue of a unit: its block id without the block's number."""
    return unit_id.rpartition("_b")[0]

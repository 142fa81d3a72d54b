"""Conversation prefix trie by the Euler-tour technique.

Each distinct sequence of first turns is a node. A node's key is two 64-bit hashes of its sequence, taken from a
running scan, so no conversation is ever a list in a task. Each node has an enter and an exit
arc; sorting the nodes below their parents gives every arc's successor:

* enter of a node -> enter of its first child, or its own exit if it has none;
* exit of a node -> enter of its next sibling, or exit of its parent if it is the last.

The tour is list-ranked distributedly: first arcs of one conversation's branch are contracted where they
lie together, then rounds splice out every arc whose coin is 1 behind one whose coin is 0 (a quarter of
what is left, one aggregate each) until at most ``BASE`` arcs remain, which one vectorised
step ranks; the rounds are then undone. Leaves and savings of a subtree are differences of running
sums at its exit and enter arcs.

A very common turn or conversation only makes longer sorted runs, which ranges split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.sorted_scan import ranged, running_sums, scan_sequences
from linkloom.plans.materialize import materialize

BASE = 16_384      # arcs that one step ranks
STRETCH = 4096     # depths of one conversation that are contracted together
BUFFER = 65_536    # arcs contracted at once (and one stretch more)
PACK = 512         # ids in a row of a node's list of ends
BRANCH = 5         # conversations that share a beginning
MOST_SHARED = 9    # first turns that may be shared: a hash modulo this


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``(conv_id, n, h1, h2, bytes)``: turns in order, ``n`` from 1, with two hashes of (role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.md5(text.cast("binary")).alias("tie"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"))
    # Rows that are equal throughout are told apart, so that ranges can split them.
    turns = turns.withColumn("row", F.monotonically_increasing_id())
    return scan_sequences(turns, "conv_id", ["turn", "role", "tie", "row"], ("h1", "h2"), ["h1", "h2", "bytes"]).select(
        "conv_id", "n", "h1", "h2", "bytes")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns ``(conv_id, piece, place, h1, h2, bytes)``, and ``(conv_id, empty)`` of all
    conversations: the first ``h`` turns of conversation c - c % 5, then c's own after its first ``h``."""
    first = (turns.where(F.col("n") <= MOST_SHARED).groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("n", "h1", "h2", "bytes"))).alias("first")))
    first = materialize(first, "first-turns")
    base = first.select(F.col("conv_id").alias("base"), F.col("first").alias("begin"))
    h = shared_turns(F.col("conv_id"))
    joined = (first.withColumn("base", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(BRANCH)))
              .join(base, "base", "left").withColumn("taken", F.when(h > 0, F.slice("begin", 1, h))))
    joined = materialize(joined.select(
        "conv_id", "taken", ((F.coalesce(F.size("taken"), F.lit(0)) <= 0) & (F.size("first") <= h)).alias("empty")), "conversations")
    convs = joined.select("conv_id", "empty")
    begins = joined.select("conv_id", F.inline("taken")).select(
        "conv_id", F.lit(0).alias("piece"), F.col("n").alias("place"), "h1", "h2", "bytes")
    own = turns.where(F.col("n") > h).select("conv_id", F.lit(1).alias("piece"), F.col("n").alias("place"), "h1", "h2", "bytes")
    return begins.unionByName(own), convs


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``(a, b, pa, pb, conv_id, depth, n_convs, save)`` of each node; the root has the key (0, 0)."""
    nodes = rows.groupBy("a", "b").agg(
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.max("n").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = nodes.withColumn("save", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes")
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"), "conv_id",
        F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("save"))
    return nodes.unionByName(root)


def _families(nodes: DataFrame) -> DataFrame:
    """Nodes below their parents, in order, with the row that follows: one row per arc.

    Row ``kind`` 0 is a node as head of its own family (its enter arc), ``kind`` 1 a node among its parent's
    children (its exit arc). Columns: ``ga, gb`` (family), ``kind``, the node's ``a, b, conv_id, depth, n_convs,
    save``; ``head`` (the family's parent's conv_id); ``follow, fa, fb`` (whether the next row is of the
    same family, and its node).
    """
    keep = ["a", "b", "conv_id", "depth", "n_convs", "save"]
    heads = nodes.select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.lit(0).alias("kind"), *keep)
    children = nodes.where(F.col("pa").isNotNull()).select(F.col("pa").alias("ga"), F.col("pb").alias("gb"), F.lit(1).alias("kind"), *keep)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head = None  # of the last row's family, if it has been seen

        def finish(rows: pa.Table, after) -> pa.Table:
            """``rows`` with their successors, the last one's being ``after`` (a row's ga, gb, a, b) or unknown."""
            own = [rows[c].to_numpy() for c in ("ga", "gb", "a", "b")]
            follow = [np.append(x[1:], 0 if after is None else after[k]) for k, x in enumerate(own)]
            same = (own[0] == follow[0]) & (own[1] == follow[1])
            edge, first = np.zeros(len(same), bool), np.zeros(len(same), bool)
            edge[-1], first[0] = after is None, not begun
            for name, x in (("follow", same & ~edge), ("fa", follow[2]), ("fb", follow[3])):
                rows = rows.append_column(name, pa.array(x))
            return rows.append_column("_part", pa.array(np.full(len(same), part, np.int32))).append_column(
                "_edge", pa.array(edge)).append_column("_first", pa.array(first))

        held, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch)
            ga, gb, kind, conv = (rows[c].to_numpy() for c in ("ga", "gb", "kind", "conv_id"))
            # A family's head is its first row; before that, the one that the rows before have left open.
            at = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
            heads_ = np.where(at >= 0, conv[np.maximum(at, 0)], 0)
            known = at >= 0
            if head is not None:
                heads_[~known], known = head, known | True
            rows = rows.append_column("head", pa.array(heads_, mask=~known))
            head = int(heads_[-1]) if known[-1] else None
            if held is not None:
                yield from finish(held, (ga[0], gb[0], rows["a"][0].as_py(), rows["b"][0].as_py())).to_batches()
                begun = True
            held = rows
        if held is not None:
            yield from finish(held, None).to_batches()

    schema = ("ga long, gb long, kind int, a long, b long, conv_id long, depth long, n_convs long, save long, "
              "head long, follow boolean, fa long, fb long, _part int, _edge boolean, _first boolean")
    rows = ranged(heads.unionByName(children), "ga", "gb", "kind", "conv_id").mapInArrow(local, schema)
    rows = materialize(rows, "families")
    # A partition's first row, and its last with the head that its family has (null: further back).
    ends = []
    for part, *rest in sorted(map(tuple, rows.where("_first OR _edge").select("_part", "ga", "gb", "kind", "conv_id", "a", "b", "head", "_edge").collect()),
                              key=lambda r: (r[0], r[-1])):
        row = dict(zip(("ga", "gb", "kind", "conv_id", "a", "b", "head"), rest))
        if not ends or ends[-1]["_part"] != part:
            ends.append({"_part": part, "first": row})
        ends[-1]["last"] = row
    patches, head = [], None
    for k, r in enumerate(ends):
        after = ends[k + 1]["first"] if k + 1 < len(ends) else None
        goes_on = after is not None and (after["ga"], after["gb"]) == (r["last"]["ga"], r["last"]["gb"])
        patches.append((r["_part"], head, goes_on, after["a"] if after else None, after["b"] if after else None))
        head = r["last"]["head"] if r["last"]["head"] is not None else head
    patches = rows.sparkSession.createDataFrame(patches, "_part int, _head long, _follow boolean, _fa long, _fb long")
    return rows.join(F.broadcast(patches), "_part").select(
        "ga", "gb", "kind", *keep, F.coalesce("head", "_head").alias("head"),
        F.when(F.col("_edge"), F.col("_follow")).otherwise(F.col("follow")).alias("follow"),
        *[F.when(F.col("_edge"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("fa", "fb")])


def tour_arcs(families: DataFrame) -> DataFrame:
    """Enter (``e`` 0) and exit (``e`` 1) arcs ``(a, b, e, na, nb, ne, ...)`` with their successors (null: the end)."""
    enter, follow = F.col("kind") == 0, F.col("follow")
    here = [F.when(enter, F.col(own)).otherwise(F.col(above)) for own, above in (("a", "ga"), ("b", "gb"))]
    arcs = families.select(
        "a", "b", F.col("kind").alias("e"), F.when(follow, F.col("fa")).otherwise(here[0]).alias("na"),
        F.when(follow, F.col("fb")).otherwise(here[1]).alias("nb"),
        F.when(follow, F.lit(0)).otherwise(F.lit(1)).alias("ne"), "conv_id", "depth", "n_convs",
        F.when(enter, F.col("save")).otherwise(F.lit(0)).alias("save"),
        F.when(enter & ~follow, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaf"),
        F.when(~enter, F.col("head")).alias("parent"))
    root = families.where((F.col("kind") == 0) & (F.col("depth") == 0))
    none = [F.lit(None).cast("long").alias(c) for c in ("na", "nb")]
    last = root.select("a", "b", F.lit(1).alias("e"), *none, F.lit(None).cast("int").alias("ne"), "conv_id", "depth", "n_convs",
                       F.lit(0).cast("long").alias("save"), F.lit(0).cast("long").alias("leaf"), F.lit(None).cast("long").alias("parent"))
    return arcs.unionByName(last)


_ID, _NEXT = ["a", "b", "e"], ["na", "nb", "ne"]


def chain_ranks(own: np.ndarray, following: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For arcs (structured keys, unique) and their successors: the successor's index or -1, each arc's
    chain head (the arc without a predecessor among them) and how many arcs lie between."""
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], following), len(own) - 1)
    found = (own[order][at] == following) & ~ends
    to = np.where(found, order[at], -1)
    back = np.full(len(own), -1)
    back[to[found]] = np.flatnonzero(found)
    head, gap = np.where(back >= 0, back, np.arange(len(own))), (back >= 0).astype(np.int64)
    while True:  # pointer jumping: a head points at itself
        nearer = head[head]
        if (nearer == head).all():
            return to, head, gap
        gap = gap + gap[head]
        head = nearer


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(columns[0]), "i8,i8,i4")
    for name, x in zip(out.dtype.names, columns):
        out[name] = x
    return out


def _long(column) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def contract_branches(arcs: DataFrame) -> DataFrame:
    """``arcs`` with ``ha, hb, he`` (the chain's first arc), ``gap`` (arcs before it in its chain); the chain's first
    arc also has ``size`` (arcs of the chain), and ``na, nb, ne`` are the chain's successor.

    Chains are built from arcs of one conversation and up to ``STRETCH`` depths, which lie together.
    """
    added = "ha long, hb long, he int, gap long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def contract(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            cols = {c: _long(rows[c].combine_chunks()) for c in [*_ID, *_NEXT]}
            ends = rows["na"].is_null().to_numpy()
            own = _keys([cols[c] for c in _ID])
            to, head, gap = chain_ranks(own, _keys([cols[c] for c in _NEXT]), ends)
            size = np.bincount(head, minlength=len(head))
            tail = np.flatnonzero(to < 0)
            out = np.arange(len(head))
            out[head[tail]] = tail  # a chain's successor is its last arc's
            for k, c in enumerate(_NEXT):
                rows = rows.set_column(rows.schema.get_field_index(c), c, pa.array(cols[c][out], rows.schema.field(c).type, mask=ends[out]))
            is_head = head == np.arange(len(head))
            for name, x in (("ha", cols["a"][head]), ("hb", cols["b"][head]), ("he", cols["e"][head].astype(np.int32)), ("gap", gap)):
                rows = rows.append_column(name, pa.array(x))
            return rows.append_column("size", pa.array(size, pa.int64(), mask=~is_head)).drop_columns(["stretch"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch)
            conv, stretch = rows["conv_id"].to_numpy(), rows["stretch"].to_numpy()
            new = np.flatnonzero((conv[1:] != conv[:-1]) | (stretch[1:] != stretch[:-1])) + 1
            if held and (held[-1]["conv_id"][-1].as_py(), held[-1]["stretch"][-1].as_py()) != (conv[0], stretch[0]):
                new = np.concatenate([[0], new])
            if sum(t.num_rows for t in held) + batch.num_rows >= BUFFER and len(new):
                cut = int(new[-1])
                rows_before = pa.concat_tables([*held, rows.slice(0, cut)])
                if rows_before.num_rows:
                    yield from contract(rows_before).to_batches()
                held = [rows.slice(cut)]
            else:
                held.append(rows)
        if held:
            yield from contract(pa.concat_tables(held)).to_batches()

    stretched = arcs.withColumn("stretch", F.floor(F.col("depth") / STRETCH).cast("long"))
    order = ["conv_id", "stretch"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arcs.schema.fields) + f", {added}"
    return stretched.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _coin(columns: list, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), *columns), F.lit(2))


def splice(links: DataFrame, turn: int) -> DataFrame:
    """One contraction round over ``links(a, b, e, na, nb, ne, size)``: an arc whose coin is 1 behind one whose coin is 0 is
    spliced out. Rows that stay have ``gone`` false and their new successor and size; spliced rows have ``gone``
    true, and ``na, nb, ne`` is the arc that they come after, ``size`` arcs later."""
    no = F.lit(None).cast(links.select(F.struct(*_ID, "size").alias("x")).schema["x"].dataType)
    none = F.lit(None).cast(links.select(F.struct(*_NEXT, "size").alias("x")).schema["x"].dataType)
    both = links.select(F.struct(*_ID).alias("x"), F.struct(*_NEXT, "size").alias("own"), no.alias("before")).union(
        links.select(F.struct(*[F.col(n).alias(i) for n, i in zip(_NEXT, _ID)]), none, F.struct(*_ID, "size")))
    met = both.groupBy("x").agg(F.max("own").alias("own"), F.max("before").alias("before"))
    mine = _coin([F.col(f"x.{c}") for c in _ID], turn)
    theirs = _coin([F.col(f"before.{c}") for c in _ID], turn)
    spliced = F.col("own").isNotNull() & F.col("before").isNotNull() & (mine == 1) & (theirs == 0)
    row = lambda source, target, size, gone: F.struct(
        *[c.alias(n) for c, n in zip(source, _ID)], *[c.alias(n) for c, n in zip(target, _NEXT)], size.alias("size"), F.lit(gone).alias("gone"))
    x, before, own = ([F.col(f"{s}.{c}") for c in names] for s, names in (("x", _ID), ("before", _ID), ("own", _NEXT)))
    stays = F.when(F.col("own").isNotNull() & (mine == 1) & ~spliced, row(x, own, F.col("own.size"), False))
    gone = F.when(spliced, row(x, before, F.col("before.size"), True))
    # The arc before (coin 0, never spliced out) is written where its successor is known.
    longer = F.when(spliced, row(before, own, F.col("before.size") + F.col("own.size"), False)).when(
        F.col("before").isNotNull() & (theirs == 0), row(before, x, F.col("before.size"), False))
    return met.select(F.inline(F.filter(F.array(stays, gone, longer), lambda r: r.isNotNull())))


def list_ranks(links: DataFrame, base: int = BASE) -> DataFrame:
    """``(a, b, e, pos)``: how many arcs (by ``size``) lie before each in the one list that ``links`` form.

    Rounds of :func:`splice` leave about three quarters of the arcs each, until at most ``base`` are left."""
    undone, turn = [], 0
    links = links.select(*_ID, *_NEXT, "size")
    left = links.count()
    while left > base:
        spliced = materialize(splice(links, turn), "spliced")
        undone.append(spliced.where("gone"))
        links = spliced.where("NOT gone").drop("gone")
        left, turn = links.count(), turn + 1

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pa.table(b) for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.concat_tables(rows)
        cols = {c: _long(rows[c].combine_chunks()) for c in [*_ID, *_NEXT, "size"]}
        ends = rows["na"].is_null().to_numpy()
        to, _, _ = chain_ranks(_keys([cols[c] for c in _ID]), _keys([cols[c] for c in _NEXT]), ends)
        back = np.full(len(to), -1)
        back[to[to >= 0]] = np.flatnonzero(to >= 0)
        up = np.where(back >= 0, back, np.arange(len(to)))
        pos = np.where(back >= 0, cols["size"][up], 0)
        while (up[up] != up).any():
            pos, up = pos + pos[up], up[up]
        yield pa.RecordBatch.from_arrays([pa.array(cols["a"]), pa.array(cols["b"]), pa.array(cols["e"].astype(np.int32)), pa.array(pos)],
                                         names=[*_ID, "pos"])

    # At most ``base`` rows.
    ranks = materialize(links.coalesce(1).mapInArrow(rank, "a long, b long, e int, pos long"), "list-ranks")
    for spliced in reversed(undone):
        after = ranks.select(*[F.col(i).alias(n) for i, n in zip(_ID, _NEXT)], "pos")
        ranks = ranks.unionByName(spliced.join(after, _NEXT).select(*_ID, (F.col("pos") + F.col("size")).alias("pos")))
        ranks = materialize(ranks, "list-ranks")  # else each round would double the plan
    return ranks


def end_digests(rows: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)`` of ``rows(a, b, conv_id)``: SHA-256 of each node's conv_ids in order, joined by commas.

    Ids are sorted over all partitions and joined in packs; a node's packs then pass one task in order, which
    holds one Arrow batch at a time (the digest itself is sequential)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(k).to_numpy() for k in range(3))
            n = len(a)
            if not n:
                continue
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            inside = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            starts = np.flatnonzero(inside % PACK == 0)
            ids = [",".join(map(str, x.tolist())) for x in np.split(conv, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(ids)],
                                             names=["a", "b", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            yield from _digests(done)
        if key is not None:
            yield from _digests([(*key, state.hexdigest())])

    packs = ranged(rows.select("a", "b", "conv_id"), "a", "b", "conv_id").mapInArrow(pack, "a long, b long, first long, ids string")
    return (packs.repartition("a", "b").sortWithinPartitions("a", "b", "first")
            .mapInArrow(digest, "a long, b long, ends_sha256 string"))


def _digests(done: list[tuple]) -> Iterator[pa.RecordBatch]:
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["a", "b", "ends_sha256"])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", base: int = BASE) -> DataFrame:
    """One row per trie node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by turn (null first), then role, then the text's MD5 (so that repeated turns have one
    order; rows that are equal throughout each count as a turn). Null role or text is ''. Rows without a
    conv_id take no part; negative ids share a beginning by the non-negative remainder. Other columns are not
    read. An empty table gives an empty result (no root). Sequences are compared by 128-bit hashes.
    """
    turns = materialize(ordered_turns(conversations, conv_col, turn_col, role_col, text_col), "turns")
    pieces, convs = rebuilt_turns(turns)
    rows = materialize(scan_sequences(pieces, "conv_id", ["piece", "place"], ("h1", "h2"), ["bytes"]), "rebuilt")
    nodes = materialize(trie_nodes(rows, convs), "trie-nodes")
    families = _families(nodes)
    arcs = materialize(contract_branches(tour_arcs(families)), "arcs")
    ranks = list_ranks(arcs.where("size IS NOT NULL"), base)
    heads = ranks.select(F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("e").alias("he"), "pos")
    placed = arcs.join(heads, ["ha", "hb", "he"]).withColumn("pos", F.col("pos") + F.col("gap"))
    about = ["a", "b", "e", "conv_id", "depth", "n_convs", "parent"]
    placed = placed.select("pos", *about, "leaf", "save", F.col("leaf").alias("own_leaf"), F.col("save").alias("own_save"))
    sums = running_sums(placed, "pos", ["leaf", "save"], [*about, "own_leaf", "own_save"])
    enter = F.col("e") == 0
    below = lambda total, own: F.when(enter, F.col(own) - F.col(total)).otherwise(F.col(total))
    none = F.lit(None)
    parts = sums.select(
        "a", "b", "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_children"),
        below("leaf", "own_leaf").alias("n_leaves"), below("save", "own_save").alias("saved_tokens"), none.cast("string").alias("ends_sha256"))
    zero = F.lit(0).cast("long")
    unknown = [none.cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    children = nodes.where("pa IS NOT NULL").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("pa").alias("a"), F.col("pb").alias("b"), *unknown, F.col("n").alias("n_children"), zero.alias("n_leaves"),
        zero.alias("saved_tokens"), none.cast("string").alias("ends_sha256"))
    lasts = rows.where("last").select("a", "b", "conv_id").unionByName(
        convs.where("empty").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    ends = end_digests(lasts).select("a", "b", *unknown, zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")
    return (parts.unionByName(children).unionByName(ends).groupBy("a", "b")
            .agg(*[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
                 *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
                 F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
            .drop("a", "b"))

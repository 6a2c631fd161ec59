"""The one sequential step of ranking: the greedy pick order of scored lists."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def greedy_order(costs, topics, sources, explore, limit, topic_penalty, source_penalty, every):
    """1-based positions in pick order, negative where the exploration rule made the pick.

    ``costs`` are negated scores in ascending order. A later entry can win only while its unpenalised score
    beats the best found so far, so each slot looks at a few entries and stops.
    """
    left = list(range(len(costs)))
    order, topic, source, first = [], None, None, True
    while left and len(order) < limit:
        at = None
        if (len(order) + 1) % every == 0:
            at = next((i for i, e in enumerate(left) if explore[e]), None)
        explored = at is not None
        if at is None:
            best = None
            for i, e in enumerate(left):
                score = -costs[e]
                if best is not None and score <= best:
                    break
                if not first:
                    if topics[e] is not None and topics[e] == topic:
                        score -= topic_penalty
                    if sources[e] == source:
                        score -= source_penalty
                if best is None or score > best:
                    best, at = score, i
        e = left.pop(at)
        order.append(-(e + 1) if explored else e + 1)
        topic, source, first = topics[e], sources[e], False
    return order


def repeated(clusters: pa.ListArray) -> np.ndarray:
    """By place in the flat values of the lists: whether an earlier entry of the same list has the cluster."""
    values, ends = _flat(clusters)
    at = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    owner, ids = np.searchsorted(ends, at, side="right"), values.take(pa.array(at)).to_numpy()
    order = np.lexsort((ids, owner))  # stable, so that equal clusters stay in the order of their places
    same = (np.diff(owner[order]) == 0) & (np.diff(ids[order]) == 0)
    again = np.zeros(len(values), dtype=bool)
    again[at[order[1:][same]]] = True
    return again


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, one after the other, and where each list ends in them."""
    return lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _numbers(values: pa.Array, missing) -> np.ndarray:
    return pc.fill_null(values, missing).to_numpy(zero_copy_only=False)


def places_in(costs, topics, sources, explore, clusters, limit, topic_penalty, source_penalty, every) -> pa.StructArray:
    """For each list its ``order`` (see ``greedy_order``) without the entries whose cluster came before, and ``again``: where those are, from 0.

    Only entries that can still be picked are walked: within both penalties of the last base slot, or eligible to explore.
    """
    again, (costs, ends) = repeated(clusters), _flat(costs)
    costs, explore, sources = _numbers(costs, np.nan), _numbers(explore.flatten(), False), _numbers(sources.flatten(), -1)
    topics = _numbers(pc.dictionary_encode(topics.flatten()).indices, -1)
    slack = topic_penalty + source_penalty + 1e-9
    orders, repeats, start = [], [], 0
    for end in ends.tolist():
        mine = again[start:end]
        at = start + np.flatnonzero(~mine)
        if len(at) > limit:
            near = int(np.searchsorted(costs[at], costs[at[limit - 1]] + slack, side="right"))
            far = at[near:]
            at = np.concatenate([at[:near], far[explore[far]][:limit]])
        named = [None if t < 0 else t for t in topics[at].tolist()]
        order = np.array(greedy_order(costs[at].tolist(), named, sources[at].tolist(), explore[at].tolist(), limit, topic_penalty, source_penalty, every), dtype=np.int64)
        orders.append((np.sign(order) * (at[np.abs(order) - 1] - start + 1)).astype(np.int32))
        repeats.append(np.flatnonzero(mine).astype(np.int32))
        start = end
    kind = pa.list_(pa.int32())
    return pa.StructArray.from_arrays([pa.array(orders, kind), pa.array(repeats, kind)], ["order", "again"])


def picked_places(
    costs: Column, topics: Column, sources: Column, explore: Column, clusters: Column, limit: int,
    topic_penalty: float = K.SAME_TOPIC_PENALTY, source_penalty: float = K.SAME_SOURCE_PENALTY, every: int = K.EXPLORATION_INTERVAL,
) -> Column:
    @F.arrow_udf("order array<int>, again array<int>")
    def places(c: pa.Array, t: pa.Array, s: pa.Array, x: pa.Array, g: pa.Array) -> pa.Array:
        return places_in(c, t, s, x, g, limit, topic_penalty, source_penalty, every)

    return places(costs, topics, sources, explore, clusters)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def repeated_places(clusters: pa.Array) -> pa.Array:
    again, (_, ends) = repeated(clusters), _flat(clusters)
    starts = np.concatenate([[0], ends[:-1]])
    return pa.array([np.flatnonzero(again[a:b]).astype(np.int32) for a, b in zip(starts, ends)], pa.list_(pa.int32()))


#: Marks that numpy holds at a time when whole pools are ranked.
MARKS_AT_ONCE = 400_000


def greedy_columns(scores, topics, sources, explore, open_to, limit, topic_penalty, source_penalty, every):
    """``greedy_order`` of many lists at once: matrices of one list a row, best score first, where ``open_to`` marks entries.

    Gives the columns picked slot by slot, -1 where a list has ended, and whether the exploration rule made the pick.
    """
    rows = np.arange(len(scores))
    left = np.where(open_to, scores, -np.inf)
    order, explored = np.full((len(scores), limit), -1), np.zeros((len(scores), limit), dtype=bool)
    topic = source = None
    for slot in range(min(limit, scores.shape[1])):
        value = left
        if slot:
            value = np.where((topics >= 0) & (topics == topic[:, None]), left - topic_penalty, left)
            value = np.where(sources == source[:, None], value - source_penalty, value)
        at = value.argmax(axis=1)
        if (slot + 1) % every == 0:
            odd = explore & (left > -np.inf)
            explored[:, slot] = odd.any(axis=1)
            at = np.where(explored[:, slot], odd.argmax(axis=1), at)
        order[:, slot] = np.where(left[rows, at] > -np.inf, at, -1)
        left[rows, at] = -np.inf
        topic, source = topics[rows, at], sources[rows, at]
    return order, explored


def _in_rank(rank: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.take_along_axis(values, rank, axis=1)


def _world_picks(scores, explore, muted, topics, sources, clusters, places, limit, topic_penalty, source_penalty, every):
    """One world of many readers: the places picked (-1: none), whether explored, and which pick covers which place."""
    scores, explore = scores[:, places], explore[:, places]
    rank = np.where(muted[:, places], np.inf, -scores).argsort(axis=1, kind="stable")
    scores, explore, muted = (_in_rank(rank, v) for v in (scores, explore, muted[:, places]))
    at, group = places[rank], clusters[places][rank]
    # Equal clusters next to each other, in rank order: all but the first of a run came before.
    runs = group.argsort(axis=1, kind="stable")
    sorted_group = _in_rank(runs, group)
    again = np.zeros_like(muted)
    np.put_along_axis(again, runs[:, 1:], (sorted_group[:, 1:] == sorted_group[:, :-1]) & (sorted_group[:, 1:] >= 0), axis=1)
    again &= ~muted
    base = ~(again | muted)
    # Entries that can still be picked: within both penalties of the last base slot, or eligible to explore.
    last = np.where(base & (base.cumsum(axis=1) <= limit), scores, np.inf).min(axis=1, initial=np.inf)
    near = base & (scores >= (last - topic_penalty - source_penalty - 1e-9)[:, None])
    far = base & ~near & explore
    can = near | (far & (far.cumsum(axis=1) <= limit // every))
    front = (~can).argsort(axis=1, kind="stable")[:, : max(int(can.sum(axis=1).max(initial=0)), 1)]
    order, explored = greedy_columns(
        *(_in_rank(front, v) for v in (scores, topics[at], sources[at], explore, can)), limit, topic_penalty, source_penalty, every
    )
    picks = np.where(order >= 0, _in_rank(np.maximum(order, 0), _in_rank(front, at)), -1)
    # A covered entry belongs to the pick of its cluster, if that was picked.
    row, slot = np.nonzero((picks >= 0) & (clusters[picks] >= 0))
    owner = np.full((len(picks), clusters.max(initial=-1) + 1), -1)
    owner[row, clusters[picks[row, slot]]] = row * limit + slot
    row, col = np.nonzero(again)
    owners = owner[row, group[row, col]]
    return picks, explored, owners[owners >= 0], at[row, col][owners >= 0]


def pool_picks(scores, explore, muted, topics, sources, clusters, worlds, limit, topic_penalty, source_penalty, every) -> pa.ListArray:
    """For each reader and world the picks from the pool: place in the pool, whether explored, score, and the places it covers.

    ``scores``, ``explore`` and ``muted`` are matrices of a reader a row and a story a column, in order of id. ``topics``, ``sources`` and
    ``clusters`` are numbers by story (below 0: none), ``worlds`` the ascending places that each holds.
    """
    readers, shape = len(scores), (len(scores), len(worlds), limit)
    picks, explored = np.full(shape, -1), np.zeros(shape, dtype=bool)
    owners, covered = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
    for w, places in enumerate(worlds):
        if len(places):
            got = _world_picks(scores, explore, muted, topics, sources, clusters, places, limit, topic_penalty, source_penalty, every)
            picks[:, w], explored[:, w] = got[0], got[1]
            row, slot = np.divmod(got[2], limit)
            owners.append((row * len(worlds) + w) * limit + slot)
            covered.append(got[3])
    owner, filled = np.concatenate(owners), picks >= 0
    behind = pa.array(np.concatenate(covered)[owner.argsort(kind="stable")].astype(np.int32))
    entries = pa.StructArray.from_arrays(
        [
            pa.array(picks[filled].astype(np.int32)), pa.array(explored[filled]), pa.array(scores[np.nonzero(filled)[0], picks[filled]]),
            _lists(np.bincount(owner, minlength=filled.size)[filled.ravel()], behind),
        ],
        ["at", "exploration", "score", "covered"],
    )
    return _lists(np.full(readers, len(worlds)), _lists(filled.sum(axis=2).ravel(), entries))


PICKS = pa.list_(pa.list_(pa.struct({"at": pa.int32(), "exploration": pa.bool_(), "score": pa.float64(), "covered": pa.list_(pa.int32())})))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def weighed(weights, topic, source, author, recency, quality, seed):
    """The score of a story, of columns or of arrays; ``seed`` is its weight where the story is seeded, else zero."""
    w = weights
    return w["topic"] * topic + w["source"] * source + w["author"] * author + w["recency"] * recency + w["quality"] * quality + seed


def _by_place(values: pa.Array, readers: int, places: np.ndarray, none) -> np.ndarray:
    """A reader's values by the stories' places in its list (from 1; 0 and null: ``none``)."""
    known = _numbers(values, none).reshape(readers, -1)
    return np.concatenate([np.full((readers, 1), none), known], axis=1)[:, places]


def pool_picked(
    topics: Column, sources: Column, authors: Column, facts: Column, worth: Column, worlds: Column, limit: int,
    topic_penalty: float = K.SAME_TOPIC_PENALTY, source_penalty: float = K.SAME_SOURCE_PENALTY, every: int = K.EXPLORATION_INTERVAL,
    weights: dict[str, float] = K.SCORE_WEIGHTS,
) -> Column:
    """``pool_picks`` of a reader's terms (``sources`` are null where muted) and of the pool's own ``facts``, ``worth`` and ``worlds``,
    which are the same in every row."""

    def ranked(t, s, a, pool) -> pa.Array:
        of, (recency, quality), tabs = pool
        n = len(t)
        topic, cold, unknown = (_by_place(v, n, of[3], none) for v, none in zip(t.flatten().flatten(), (0.0, False, False)))
        affinity, author = _by_place(s.flatten(), n, of[1], 0.0), _by_place(a.flatten(), n, of[4], 0.0)
        muted = _by_place(s.flatten().is_null(), n, of[1], False)
        scores = weighed(weights, topic, affinity, author, recency, quality, np.where(cold, weights["seed"], 0.0))
        return pool_picks(scores, unknown, muted, of[0] - 1, of[1] - 1, of[2] - 1, tabs, limit, topic_penalty, source_penalty, every)

    @F.arrow_udf("array<array<struct<at:int,exploration:boolean,score:double,covered:array<int>>>>")
    def picks(t: pa.Array, s: pa.Array, a: pa.Array, f: pa.Array, b: pa.Array, w: pa.Array) -> pa.Array:
        if not len(t):
            return pa.array([], PICKS)
        pool = np.array(f[0].as_py(), dtype=np.int64), np.array(b[0].as_py(), dtype=np.float64), [np.array(p, dtype=np.int64) for p in w[0].as_py()]
        step = max(MARKS_AT_ONCE // max(pool[0].shape[1], 1), 1)
        return pa.concat_arrays([ranked(*(v.slice(i, step) for v in (t, s, a)), pool) for i in range(0, len(t), step)])

    return picks(topics, sources, authors, facts, worth, worlds)

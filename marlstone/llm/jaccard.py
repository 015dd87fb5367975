"""Similarity self-join on word shingles: a size-aware heavy-light join.

Documents with equal shingle sets are one class; classes, not documents, are compared. Light (small)
sets meet in subsets of a fixed size: two sets of which one holds most of the other share a subset
that is left when a few elements go. Heavy (large) sets meet in inverted lists over the elements that
come first in one global order (an element that many sets hold comes last): sets that are alike share
one of these. The size between the two is where the estimated cost is least; sets near it take part
in both. The members of a list are compared exactly, in sets that lie memory-mapped in the shared
folder, by what sets it from the list's common core. A long list is dealt in blocks: those of a first
round connect most of it, then only members that aren't connected yet are asked against the whole
list, spread over tasks.

Defined cases: a null or empty text, or one without words, has no shingles and no links; with fewer
words than a shingle has the whole sequence is one; rows with equal doc_ids are separate rows of one
number; ties can't occur (a component's number is its smallest doc_id, null where all are); a very
long text is a chunk of its own; an empty table gives no rows; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cached, forget, get_arrays, keep_one, keyed_text, mix, over_chunks, partitions, put_arrays, ranges, shared_dir, task_number, words
from marlstone.llm.components import components

_FILE_BITS, _INDEX_BITS = 12, 25
_FILE_ELEMENTS = 1 << 22
#: Elements of the sets that are compared at a time.
_BLOCK_ELEMENTS = 1 << 21
ROWS = "is_set int, entry long, n long, a long, b long, doc_id long, digest binary"


def text_digest() -> Column:
    """Tells rows of one doc_id apart."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of each text, ascending within a text, and how many each text has."""
    distinct, code, counts = words(texts, lower=True)
    named = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[code]
    ends = np.cumsum(counts)
    n = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    at, doc = ranges(ends - counts, n), np.repeat(np.arange(len(counts)), n)
    h = np.full(len(at), 0x51ED270B, np.uint64)
    for k in range(size):
        word = np.where(k < counts[doc], named[np.minimum(at + k, max(len(named) - 1, 0))], np.uint64(k)) if len(at) else h
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
    return h[fresh], np.bincount(doc[fresh], minlength=len(counts))


def least_common(n: int, percent: int) -> int:
    """How many of a set's n elements each set like it holds."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_common(n, percent) + 1


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, k) for k in range(n - least_common(n, percent) + 1))


def boundary(sizes: dict[int, int], percent: int, work: dict[int, int] | None = None, most: int = 20) -> int:
    """The size up to which subsets cost less than lists, in elements that are touched.

    ``sizes``: sets by size, up to the size that meets ``most`` in a list; ``work``: of the sets of a
    size, with how many members their lists would have them compared, as measured.
    """
    work = work or {}

    def cost(b: int) -> float:
        light = sum(c * n * subset_count(n, percent) for n, c in sizes.items() if n <= b)
        return light + sum(2.0 * n * (c * prefix_length(n, percent) + work.get(n, 0)) for n, c in sizes.items() if n >= least_common(b + 1, percent))

    return min(range(most + 1), key=cost)


def _list_work(classes: DataFrame, place: str, common: np.ndarray, percent: int) -> dict[int, int]:
    """By size of small sets: the lengths of all lists that they would be in."""
    per = _postings(classes, place, common, 0, percent).groupBy("key", "n").agg(F.count(F.lit(1)).alias("c"))
    total = per.groupBy("key").agg(F.sum("c").alias("length"))
    return {r.n: r.work for r in per.join(total, "key").groupBy("n").agg(F.sum(F.col("c") * (F.col("length") - 1)).alias("work")).collect()}


def _sets(docs: DataFrame, size: int, place: str) -> DataFrame:
    """Writes the sets to files. A row for each document, and one for each set that its task met first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        context = TaskContext.get()
        task = (task_number() << 4 | (context.attemptNumber() & 15 if context else 0)) << (_FILE_BITS + _INDEX_BITS)
        known: dict[tuple[int, int], int] = {}
        rows: dict[int, list] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        number = count = elements = 0

        def flush() -> dict:
            nonlocal number, count, elements, held, rows
            values, n = (np.concatenate(x) for x in zip(*held, strict=True))
            put_arrays(f"{place}/{task + (number << _INDEX_BITS) >> _INDEX_BITS}.sets", values=values, ends=np.concatenate([[0], np.cumsum(n)]))
            e = list(rows.values())
            out = {"is_set": [1] * len(e), "entry": list(rows), "n": [x[0] for x in e], "a": [x[1] for x in e], "b": [x[2] for x in e], "doc_id": [x[3] for x in e], "digest": pa.nulls(len(e), pa.binary())}
            number, count, elements, held, rows = number + 1, 0, 0, [], {}
            known.clear()
            return out

        for part in parts:
            values, n = shingles(part.column("text"), size)
            start = np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)))]) for salt in (0x1234567, 0x89ABCDEF)]
            a, b = ((s[start[1:]] - s[start[:-1]]).view(np.int64).tolist() for s in sums)
            ids, new, entry = part.column("doc_id").to_pylist(), [], []
            for i, (doc, k) in enumerate(zip(ids, n.tolist(), strict=True)):
                if not k:
                    entry.append(None)
                    continue
                e = known.get((a[i], b[i]))
                if e is None:
                    e = known[a[i], b[i]] = task + (number << _INDEX_BITS) + count
                    rows[e] = [k, a[i], b[i], doc]
                    count += 1
                    new.append(i)
                elif doc is not None and (rows[e][3] is None or doc < rows[e][3]):
                    rows[e][3] = doc
                entry.append(e)
            if new:
                new = np.array(new)
                held.append((values[ranges(start[new], n[new])], n[new]))
                elements += int(n[new].sum())
            yield {"is_set": [0] * len(ids), "entry": entry, "n": n, "a": [0] * len(ids), "b": [0] * len(ids), "doc_id": ids, "digest": part.column("digest")}
            if elements >= _FILE_ELEMENTS:
                yield flush()
        if held:
            yield flush()

    return over_chunks(keyed_text(docs).withColumn("digest", text_digest()), run, ROWS)


def load(place: str, entry: int) -> np.ndarray:
    f, i = cached(f"{place}/{entry >> _INDEX_BITS}.sets"), entry & (1 << _INDEX_BITS) - 1
    return f["values"][f["ends"][i] : f["ends"][i + 1]]


def _unmapped(run, place: str):
    """The same work of a task; the files that it mapped are let go at its end."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        try:
            yield from run(parts)
        finally:
            forget(place)

    return task


def _common(classes: DataFrame, place: str, most: int, local: int = 3, per_batch: int = 2000) -> np.ndarray:
    """Elements that many sets hold, rarest first: at most ``most``. Any order serves; a good one keeps lists short."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            ids = part.column("entry").to_pylist()
            if not ids:
                continue
            for at in range(0, len(ids), 2000):
                v, c = np.unique(np.concatenate([load(place, e) for e in ids[at : at + 2000]]), return_counts=True)
                top = np.flatnonzero(c >= local)
                top = top[np.argsort(-c[top], kind="stable")[:per_batch]]
                yield {"element": v[top].view(np.int64), "c": c[top]}

    counted = over_chunks(classes, _unmapped(run, place), "element long, c long", limit=0).groupBy("element").agg(F.sum("c").alias("c"))
    return np.array([r.element for r in counted.orderBy(F.desc("c"), "element").limit(most).collect()][::-1], np.int64).view(np.uint64)


def _postings(classes: DataFrame, place: str, common: np.ndarray, light: int, percent: int) -> DataFrame:
    """For each set the keys under which it meets others: first elements, and sums of subsets."""
    order = np.argsort(common)
    names, rank = common[order], order.astype(np.int64) + 1  # 0: not common

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        heavy_from = least_common(light + 1, percent)
        for part in parts:
            keys, sets, sizes = [np.zeros(0, np.uint64)], [], []
            for e in part.column("entry").to_pylist():
                v = load(place, e)
                n, before = len(v), len(keys)
                if n <= light:
                    m = mix(v)
                    total = m.sum()
                    for k in range(n - least_common(n, percent) + 1):
                        gone = np.array([m[list(c)].sum() for c in combinations(range(n), k)], np.uint64) if k else np.zeros(1, np.uint64)
                        keys.append(mix(total - gone + np.uint64(n - k)))
                if n >= heavy_from:
                    p = prefix_length(n, percent)
                    at = np.searchsorted(names, v)
                    r = np.where(names[np.minimum(at, len(names) - 1)] == v, rank[np.minimum(at, len(names) - 1)], 0) if len(names) else np.zeros(n, np.int64)
                    rare = v[r == 0]
                    keys.append(rare[:p] if len(rare) >= p else np.concatenate([rare, v[np.argsort(r, kind="stable")][len(rare) : p]]))
                made = sum(map(len, keys[before:]))
                sets += [e] * made
                sizes += [n] * made
            yield {"key": np.concatenate(keys).view(np.int64), "entry": sets, "n": sizes}

    return over_chunks(classes, _unmapped(run, place), "key long, entry long, n int", limit=0)


def _lists(postings: DataFrame, percent: int, block: int) -> DataFrame:
    """The members of every key that several sets have, cut where sizes are too far apart; a long list comes in blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: set[int] = set()
        rest = [np.zeros(0, np.int64)] * 3

        def closed(key: np.ndarray, entry: np.ndarray, n: np.ndarray) -> dict | None:
            cut = np.flatnonzero((key[1:] != key[:-1]) | (percent * n[1:] > 100 * n[:-1]))
            begin, end = np.concatenate([[0], cut + 1]), np.concatenate([cut + 1, [len(key)]])
            out = []
            for b, e in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
                members, at = np.unique(entry[b:e], return_index=True)
                if len(members) > 1 and (name := xxhash.xxh3_64_intdigest(members.tobytes()) >> 1) not in known:
                    if len(known) < 1_000_000:
                        known.add(name)
                    number = np.maximum(np.arange(len(members)) // block, np.cumsum(n[b:e][at]) // _BLOCK_ELEMENTS)
                    pieces = np.split(members, np.flatnonzero(np.diff(number)) + 1)
                    out += [(name, k, len(pieces) == 1, x.tolist()) for k, x in enumerate(pieces)]
            return {"name": [o[0] for o in out], "number": [o[1] for o in out], "whole": [o[2] for o in out], "members": [o[3] for o in out]} if out else None

        for part in parts:
            now = [np.concatenate([r, part.column(c).to_numpy().astype(np.int64)]) for r, c in zip(rest, ("key", "entry", "n"), strict=True)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            rest = [x[last:] for x in now]
            if last and (out := closed(*(x[:last] for x in now))):
                yield out
        if len(rest[0]) and (out := closed(*rest)):
            yield out

    ordered = postings.repartition("key").sortWithinPartitions("key", "n")
    return over_chunks(ordered, run, "name long, number long, whole boolean, members array<long>", limit=0)


class Overlaps:
    """How many elements one of some sets shares with each of them.

    Sets of a list are often near copies. An element that most of them hold is in the core, and a set
    is kept as what it lacks of the core and what it has beyond it, with inverted lists over these.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        inner = 2 * np.bincount(code) > len(sets)
        number = np.cumsum(inner) - 1
        core = inner[code]
        lacks = np.ones((len(sets), int(inner.sum())), bool)
        lacks[owner[core], number[code[core]]] = False
        who, what = np.nonzero(lacks)
        self.core, self.lacks = lacks.shape[1], lacks.sum(1)
        who, what = np.concatenate([who, owner[~core]]), np.concatenate([np.flatnonzero(inner)[what], code[~core]])
        order = np.lexsort((what, who))
        self.own, self.ends = what[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(sets)))])
        self.inverted, self.begins = who[np.argsort(what, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(what, minlength=len(inner)))])

    def of(self, i: int) -> np.ndarray:
        mine = self.own[self.ends[i] : self.ends[i + 1]]
        met = self.inverted[ranges(self.begins[mine], self.begins[mine + 1] - self.begins[mine])]
        return self.core - self.lacks[i] - self.lacks + np.bincount(met, minlength=len(self.size))


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets that are alike, enough of them to connect all that a chain of such pairs connects.

    Every set is asked once which of those not reached yet are like it, so there are fewer links than sets.
    """
    size = np.array([len(s) for s in sets])
    out: list[tuple[int, int]] = []
    overlaps = Overlaps(sets) if len(sets) > 12 else None

    def alike(i: int, left: np.ndarray) -> np.ndarray:
        if overlaps:
            both = overlaps.of(i)[left]
        else:
            one, n = sets[i], size[left]
            flat = np.concatenate([sets[k] for k in left.tolist()])
            hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
        return 100 * both >= percent * (size[i] + size[left] - both)

    left = np.arange(len(sets))
    while len(left) > 1:
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            i = waiting.pop()
            found = alike(i, left)
            out += [(i, k) for k in left[found].tolist()]
            waiting += left[found].tolist()
            left = left[~found]
    return out


def links_between(asked: list[np.ndarray], sets: list[np.ndarray], group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of one of ``asked`` and one of ``sets`` that are alike, but of other groups: one for each group that a set meets.

    ``group``: the groups' numbers, first of ``asked``, then of ``sets``.
    """
    n, out = len(asked), []
    overlaps = Overlaps([*asked, *sets])
    for i in range(n):
        both = overlaps.of(i)[n:]
        found = np.flatnonzero((100 * both >= percent * (overlaps.size[i] + overlaps.size[n:] - both)) & (group[n:] != group[i]))
        for g, k in dict(zip(group[n:][found].tolist(), found.tolist(), strict=True)).items():
            out.append((i, k))
            group[group == g] = group[i]
    return out


def _edges(lists: DataFrame, place: str, percent: int) -> DataFrame:
    """Links within each block."""
    # lists are small but long to compare: a stated number of partitions isn't merged by their bytes
    lists = lists.repartition(partitions(lists.sparkSession), "name", "number").dropDuplicates(["name", "number"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            done: list[tuple[int, int]] = []
            for members in part.column("members").to_pylist():
                done += [(members[i], members[j]) for i, j in links([load(place, e) for e in members], percent)]
            yield {"a": [x for x, _ in done], "b": [x for _, x in done]}

    return over_chunks(lists, _unmapped(run, place), "a long, b long", limit=0)


def _far_edges(blocks: DataFrame, found: DataFrame, place: str, lists: str, percent: int, block: int, asked: int = 64) -> DataFrame:
    """Links between the blocks of long lists that the first round's components don't connect yet.

    Of two members in different components at least one isn't in the list's most frequent component.
    All such members are asked, few at a time and spread over tasks, against the whole list, block by
    block; a list within one component needs no more work.
    """
    members = blocks.select("name", F.explode("members").alias("entry")).distinct()
    named = members.join(found, members["entry"] == found["node"], "left").select("name", "entry", F.coalesce("root", "entry").alias("root"))
    named.write.parquet(f"{lists}/named")
    named = named.sparkSession.read.parquet(f"{lists}/named")
    kinds = named.groupBy("name", "root").agg(F.count(F.lit(1)).alias("n"))
    most = kinds.groupBy("name").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("length"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for name, entries, roots in zip(*(part.column(c).to_pylist() for c in ("name", "entries", "roots")), strict=True):
                put_arrays(f"{lists}/{name}.list", members=np.array(entries, np.int64), roots=np.array(roots, np.int64))
                yield {"name": [name]}

    together = named.join(most, "name", "left_semi").groupBy("name").agg(F.collect_list("entry").alias("entries"), F.collect_list("root").alias("roots"))
    over_chunks(together, keep, "name long", limit=0).count()
    slot = F.pmod(F.xxhash64("entry"), F.ceil(F.col("length") / asked)).alias("slot")
    units = named.join(most, "name").where("root <> most").groupBy("name", slot).agg(F.collect_list("entry").alias("entries"), F.collect_list("root").alias("roots"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            done: list[tuple[int, int]] = []
            for name, entries, roots in zip(*(part.column(c).to_pylist() for c in ("name", "entries", "roots")), strict=True):
                whole, root = get_arrays(f"{lists}/{name}.list"), np.array(roots)
                mine = [load(place, e) for e in entries]
                others, sets, size = [], [], 0
                for k, e in enumerate(whole["members"].tolist(), 1):
                    others.append(e)
                    sets.append(load(place, e))
                    size += len(sets[-1])
                    if k == len(whole["members"]) or len(sets) == block or size >= _BLOCK_ELEMENTS:
                        group = np.concatenate([root, whole["roots"][k - len(sets) : k]])
                        done += [(entries[i], others[j]) for i, j in links_between(mine, sets, group, percent)]
                        others, sets, size = [], [], 0
            yield {"a": [x for x, _ in done], "b": [x for _, x in done]}

    return over_chunks(units.repartition(partitions(units.sparkSession), "name", "slot"), _unmapped(run, place), "a long, b long", limit=0)


def _grouped(docs: DataFrame, shingle: int, percent: int, common: int, block: int, place: str) -> DataFrame:
    """doc_id, digest (of the text), n (set size) and component of every document; documents without words have no component."""
    spark = docs.sparkSession
    sets = f"{place}/sets"
    _sets(docs, shingle, sets).write.partitionBy("is_set").parquet(f"{place}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{place}/rows")
    same = rows.where("is_set = 1").groupBy("a", "b").agg(F.min("entry").alias("class"), F.min("doc_id").alias("least"), F.min("n").alias("n"))
    rows.where("is_set = 1").select("entry", "a", "b").join(same, ["a", "b"]).select("entry", "class", "least", "n").write.parquet(f"{place}/classes")
    members = spark.read.parquet(f"{place}/classes")
    classes = members.where("entry = class")
    by_file = classes.select("entry", "n").repartition(partitions(spark), F.shiftright("entry", _INDEX_BITS)).sortWithinPartitions("entry")
    often = _common(by_file, sets, common)
    small = {r.n: r["count"] for r in classes.where("n <= 24").groupBy("n").count().collect()}
    light = boundary(small, percent, _list_work(by_file.where("n <= 24"), sets, often, percent))
    _lists(_postings(by_file, sets, often, light, percent), percent, block).write.parquet(f"{place}/lists/blocks")
    blocks = spark.read.parquet(f"{place}/lists/blocks")
    _edges(blocks, sets, percent).write.parquet(f"{place}/links")
    links_ = spark.read.parquet(f"{place}/links")
    found = components(links_, f"{place}/stars")
    long = blocks.where("NOT whole")
    if not long.isEmpty():
        _far_edges(long, found, sets, f"{place}/lists", percent, block).write.parquet(f"{place}/links2")
        found = components(links_.unionByName(spark.read.parquet(f"{place}/links2")), f"{place}/stars2")
    members.join(found, members["class"] == found["node"], "left").select("entry", "least", F.coalesce("root", "class").alias("root")).write.parquet(f"{place}/rooted")
    rooted = spark.read.parquet(f"{place}/rooted")
    rooted.groupBy("root").agg(F.min("least").alias("component")).write.parquet(f"{place}/roots")
    # both sides are exchanged for the join alone, so a large component's rows can be split
    entries = rooted.join(spark.read.parquet(f"{place}/roots"), "root").select("entry", "root", "component")
    documents = rows.where("is_set = 0").select("doc_id", "n", "entry", "digest")
    wordless = documents.where("entry IS NULL").select("doc_id", "n", "digest", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("component"))
    return documents.join(entries, "entry").select("doc_id", "n", "digest", "root", "component").unionByName(wordless)


def similar_groups(docs: DataFrame, shingle: int = 4, percent: int = 85, common: int = 50_000, block: int = 1024) -> DataFrame:
    """Links documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).
    ``common`` bounds the list of frequent elements that all tasks get (8 bytes each), ``block`` the
    members of a list that are compared at a time; both change nothing but speed.
    """
    rows = _grouped(docs, shingle, percent, common, block, shared_dir(docs.sparkSession))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, common: int = 50_000, block: int = 1024) -> DataFrame:
    """Of each group one document with the smallest doc_id stays, with all columns; of several with that
    doc_id the one with the smallest digest of its text. Rows without words are groups of their own and
    stay, but for repetitions of a row's doc_id and text. A group all of whose doc_ids are null keeps one too."""
    place = shared_dir(docs.sparkSession)
    rows = _grouped(docs, shingle, percent, common, block, place).where("component IS NULL OR doc_id <=> component")
    per_text = rows.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    per_text.write.parquet(f"{place}/kept")
    per_text = docs.sparkSession.read.parquet(f"{place}/kept")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "copies")).alias("best")
    chosen = per_text.where("root IS NOT NULL").groupBy("root").agg(best).select("best.doc_id", "best.digest", "best.copies")
    return keep_one(docs, chosen.unionByName(per_text.where("root IS NULL").drop("root").select("doc_id", "digest", "copies")), digest=text_digest())

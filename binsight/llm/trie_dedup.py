"""Exact duplicates by Patricia-trie owners.

Texts are equal when they are the same bytes after every run of white space
became one space.  Tries decide that, byte by byte:

1. Every task inserts its texts into tries of its own, one for each length, and
   so reduces the copies it has seen to one *representative* with their number
   and smallest id.  A text that fills a third of the table leaves one
   representative a task (one for every ``CHUNK`` of rows or bytes).
2. The representatives move to partitions of their length and content hash,
   where their full bytes go into compressed radix tries.  The terminal node
   keeps the smallest id (the owner), the number of rows and the representatives
   that ended there.
3. A partition that outgrows ``max_bytes`` spills by subtree: the heaviest
   subtree leaves as rows, and so does every later text that walks into it.
   What was spilled is dealt anew over all partitions in a further round, until
   nothing is left over.  At least one text a task stays in every round.
4. Documents find their owner through their representative's number, never by a
   hash, and a representative stands for at most a chunk of rows, so a hot text
   makes no hot key.

Representatives are written once to the shared folder, so their numbers hold
when an executor is lost.

Defined results: a null text counts as empty; empty texts are equal to one
another, and so are texts of white space only (one space).  Exactly one row of
each group is kept.  Rows that repeat id and text are copies of which one is
kept; a null id comes after all others, and a group without any id keeps one of
its rows (keep_id null).  An empty table gives an empty result; further columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import as_bytes, ship, slices, written

#: rows, and bytes of distinct texts, that a task reduces at a time
CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 32 << 20
#: bytes that the tries of a partition hold before they spill
MAX_BYTES = 64 << 20
#: representatives named in one row of the result
_NAMED = 10_000
#: what a node takes beside the bytes of its label
_NODE = 400

# runs of white space other than a single space
_BLANKS = re.compile(rb"[\t-\r][ \t-\r]*| [ \t-\r]+")

_REPS = "doc_id long, rep long, digest binary, lead boolean, length long, hash long, body binary, low long, n long"
_OWNED = "reps array<long>, lead long, length long, hash long, body binary, low long, n long"


def normalised(body: bytes) -> bytes:
    return _BLANKS.sub(b" ", body)


class Node:
    __slots__ = ("children", "label", "own", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.own, self.spilled = label, {}, None, False


class Trie:
    """Compressed radix trie over byte strings.  ``held`` estimates its bytes."""

    def __init__(self):
        self.root, self.held = Node(b""), _NODE

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made where there is none; the spilled node
        on its way if there is one."""
        node, at, end = self.root, 0, len(text)
        while at < end and not node.spilled:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += end - at + _NODE
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(child.label, text, at)
            middle = Node(child.label[:n])
            middle.children[child.label[n]] = child
            child.label = child.label[n:]
            node.children[text[at]] = middle
            self.held += _NODE
            node, at = middle, at + n
        return node

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Take out the heaviest subtree below the first branching and give its texts
        with what their terminals hold; nothing if the trie is a single path."""
        node, path = self.root, b""
        while node.own is None and len(live := [c for c in node.children.values() if not c.spilled]) == 1:
            node = live[0]
            path += node.label
        live = [c for c in node.children.values() if not c.spilled]
        if not live:
            return
        weight, heaviest = max(((sum(len(n.label) + _NODE for n, _ in _walk(c, b"")), c) for c in live), key=lambda w: w[0])
        for n, prefix in _walk(heaviest, path):
            if n.own is not None:
                yield prefix + n.label, n.own
        heaviest.children, heaviest.own, heaviest.spilled = {}, None, True
        self.held -= weight

    def owners(self) -> Iterator[list]:
        return (n.own for n, _ in _walk(self.root, None) if n.own is not None)


def _walk(node: Node, prefix: bytes | None) -> Iterator[tuple[Node, bytes | None]]:
    """The nodes of a subtree with what leads to them (left out if ``prefix`` is None)."""
    todo = [(node, prefix)]
    while todo:
        node, prefix = todo.pop()
        yield node, prefix
        below = None if prefix is None else prefix + node.label
        todo.extend((c, below) for c in node.children.values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text[at:]`` (1 at least)."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _before(a: int | None, b: int | None) -> bool:
    """Whether id ``a`` comes before ``b``; null comes last."""
    return a is not None and (b is None or a < b)


def _representatives(chunk_rows: int, chunk_bytes: int) -> Callable:
    """Documents -> one row each; the row with the smallest id of those with the same
    text in a chunk leads them and carries the text."""
    import xxhash

    def run(batches):
        following = TaskContext.get().partitionId() << 33
        tries, rows, terminals = {}, [], []

        def finish():
            out = []
            for at, (doc, own) in enumerate(rows):
                lead = own[3] == at
                out.append((doc, own[0], own[1], lead, len(own[4]) if lead else None,
                            xxhash.xxh64_intdigest(own[4]) - (1 << 63) if lead else None, own[4] if lead else None,
                            own[2] if lead else None, own[5] if lead else None))
            tries.clear()
            rows.clear()
            terminals.clear()
            return _batches(out, _REPS)

        held = 0
        for batch in slices(batches):
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                text = normalised(body.as_py())
                trie = tries.get(len(text)) or tries.setdefault(len(text), Trie())
                before = trie.held
                node = trie.terminal(text)
                held += trie.held - before
                if node.own is None:
                    # number, digest, smallest id, its row, text, rows
                    node.own = [following, hashlib.sha256(text).digest(), doc, len(rows), text, 1]
                    following += 1
                    held += len(text)
                else:
                    node.own[5] += 1
                    if _before(doc, node.own[2]):
                        node.own[2], node.own[3] = doc, len(rows)
                rows.append((doc, node.own))
            if len(rows) >= chunk_rows or held >= chunk_bytes:
                yield from finish()
                held = 0
        yield from finish()
    return run


def _batches(rows: list[tuple], schema: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; a column called body weighs its bytes."""
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    body = [name for name, _ in fields].index("body")
    start, size = 0, 0
    for at, row in enumerate(rows):
        size += 64 + len(row[body] or b"")
        if size >= max_bytes or at == len(rows) - 1:
            columns = zip(*rows[start:at + 1], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
                                             names=[name for name, _ in fields])
            start, size = at + 1, 0


def _owners(max_bytes: int) -> Callable:
    """Representatives of a partition -> a row (or more, by the number named) for each
    text without its body; rows with a body were spilled."""
    def run(batches):
        tries: dict[int, Trie] = {}
        held = 0
        for batch in slices(batches):
            spilled = []
            for reps, lead, length, code, body, low, n in zip(*(batch.column(c).to_pylist() for c in ("reps", "lead", "length", "hash", "body", "low", "n")), strict=True):
                trie = tries.get(length) or tries.setdefault(length, Trie())
                before = trie.held
                node = trie.terminal(body)
                if node.spilled:
                    spilled.append((reps, lead, length, code, body, low, n))
                    continue
                if node.own is None:
                    node.own = [reps, lead, length, code, low, n]
                else:
                    node.own[0] += reps
                    node.own[5] += n
                    if _before(low, node.own[4]):
                        node.own[1], node.own[4] = lead, low
                trie.held += 8 * len(reps)
                held += trie.held - before
                while held > max_bytes:
                    heavy = max(tries.values(), key=lambda t: t.held)
                    before = heavy.held
                    out = [(own[0], own[1], own[2], own[3], text, own[4], own[5]) for text, own in heavy.spill()]
                    if not out:
                        break
                    spilled += out
                    held += heavy.held - before
            if spilled:
                yield from _batches(spilled, _OWNED)
        for trie in tries.values():
            named = []
            for reps, lead, length, code, low, n in trie.owners():
                named += [(reps[i:i + _NAMED], lead, length, code, None, low, n) for i in range(0, len(reps), _NAMED)]
            yield from _batches(named, _OWNED)
    return run


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS,
                 chunk_bytes: int = CHUNK_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    rows = written(as_bytes(docs, id_col, text_col).mapInArrow(_representatives(chunk_rows, chunk_bytes), _REPS))
    left = rows.where("lead").select(F.array("rep").alias("reps"), F.col("rep").alias("lead"), "length", "hash", "body", "low", "n")
    owned, turn = None, 0
    while True:
        # later rounds deal the rest anew
        place = F.col("hash") if turn == 0 else F.xxhash64("hash", F.lit(turn))
        out = written(left.repartition("length", place).mapInArrow(_owners(max_bytes), _OWNED))
        found = out.where("body is null").select(F.explode("reps").alias("rep"), F.col("lead").alias("owner"), F.col("low").alias("keep_id"), F.col("n").alias("group_size"))
        owned = found if owned is None else owned.unionByName(found)
        left, turn = out.where("body is not null"), turn + 1
        if left.isEmpty():
            break
    return rows.select("doc_id", "rep", "digest", "lead").join(owned, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("lead") & (F.col("rep") == F.col("owner"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

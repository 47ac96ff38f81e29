"""Fill-in-the-middle examples as piece tables.

A text becomes a list of descriptors (buffer, start, end) over two buffers that never change: the UTF-8 bytes of the text
and those of the sentinels. Cutting splits descriptors, a form permutes them and puts sentinel descriptors between, and the
inverse permutation brings a text back. Nothing is copied until a table is written; hashes read descriptor after descriptor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.shingles import pieces

#: Fixed values of the format: the sentinel before the prefix, the middle and the suffix.
SENTINELS = (b"<P>", b"<M>", b"<S>")
#: Order of the parts (0 prefix, 1 middle, 2 suffix) in each form.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Share of texts that are rearranged, and of those the share in the form ``spm``.
FIM_PERCENT, SPM_PERCENT = 100, 50
SEED = "7:"
#: Bytes that a hash reads at once.
STEP = 1 << 20
TEXT, MARKS = 0, 1
_MARKS = memoryview(b"".join(SENTINELS))
_MARK_AT = [(MARKS, 3 * k, 3 * k + 3) for k in range(3)]

Piece = tuple[int, int, int]


class PieceTable:
    """Descriptors over a text and the sentinels."""

    def __init__(self, text: memoryview, parts: list[Piece] | None = None):
        self.buffers = (text, _MARKS)
        self.parts = [(TEXT, 0, len(text))] if parts is None else parts

    def cut(self, at: int) -> None:
        """Split the last descriptor at offset ``at`` of its buffer; either half may be empty."""
        buffer, start, end = self.parts.pop()
        self.parts += [(buffer, start, at), (buffer, at, end)]

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
        return PieceTable(self.buffers[TEXT], [p for k in FORMS[form] for p in (_MARK_AT[k], self.parts[k])])

    def restored(self, form: str) -> PieceTable:
        """The inverse of ``arranged``."""
        kept = [p for p in self.parts if p[0] == TEXT]
        back = np.argsort(FORMS[form]).tolist()
        return PieceTable(self.buffers[TEXT], [kept[k] for k in back])

    def views(self) -> Iterator[memoryview]:
        for buffer, start, end in self.parts:
            for a in range(start, end, STEP):
                yield self.buffers[buffer][a:min(a + STEP, end)]

    def written(self) -> bytes:
        return b"".join(self.views())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()


def parsed(output: bytes, form: str) -> PieceTable:
    """The piece table of a written example: its sentinels are found again, in the order of the form.

    Texts that hold a sentinel are never rearranged, so the first one found is the one that was put there.
    """
    table = PieceTable(memoryview(output))
    if form == "plain":
        return table
    found, at = [], 0
    for k in FORMS[form]:
        at = output.index(SENTINELS[k], at) + 3
        found.append(at)
    ends = [at - 3 for at in found[1:]] + [len(output)]
    table.parts = [p for k, a, b in zip(FORMS[form], found, ends, strict=True) for p in (_MARK_AT[k], (TEXT, a, b))]
    return table


def draws(doc_id) -> list[int]:
    """Four numbers below 2^32 that depend on the id alone; a null id counts as no digits."""
    digest = hashlib.sha256((SEED + ("" if doc_id is None else str(doc_id))).encode()).digest()
    return [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all bytes but those that continue one."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def example(doc_id, text: bytes) -> tuple[int, str, int | None, int | None, PieceTable]:
    """(lines, form, code points of the prefix, of the middle, piece table of the example) of one text."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and data[-1] != 10:
        ends = np.append(ends, len(data))
    n, table = len(ends), PieceTable(memoryview(text))
    h1, h2, h3, h4 = draws(doc_id)
    if not n or h3 % 100 >= FIM_PERCENT or any(s in text for s in SENTINELS):
        return n, "plain", None, None, table
    form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    table.cut(a)
    table.cut(b)
    return n, form, characters(data[:a]), characters(data[a:b]), table.arranged(form)


def _rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    for batch in batches:
        for part in pieces(batch, 1):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                *facts, table = example(doc_id, text or b"")
                rows.append((*facts, table.written(), table.sha256()))
            n, form, prefix, middle, output, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(output, pa.binary()).cast(pa.string()), pa.array(digest)], names)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, batch.schema.get_field_index("output")):
            rows = [parsed(output, form).restored(form) if form != "plain" else parsed(output, form) for form, output in
                    zip(part.column("form").to_pylist(), part.column("output").cast(pa.binary()).to_pylist(), strict=True)]
            restored = [pa.array([t.written() for t in rows], pa.binary()).cast(pa.string()), pa.array([t.sha256() for t in rows])]
            yield pa.RecordBatch.from_arrays(part.columns + restored, part.schema.names + ["restored", "restored_sha256"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, output_sha256), one row per input row.

    A whole text of ``n`` lines is cut before two line starts (or its ends) that depend on the id alone, and written in
    the form ``psm`` or ``spm``. Empty texts and texts that hold a sentinel stay as they are (``plain``, no character
    counts); a null text is empty. Equal ids, repeated rows and null ids are cut by the same rule, so equal rows give
    equal results. An empty table gives an empty table. Other columns are ignored, whatever their names. A row never
    leaves its partition, and memory is bounded by a slice of texts and the longest one.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["id"]]).add("n", "long").add("form", "string").add("prefix_chars", "long")
    return source.mapInArrow(_rearrange, schema.add("middle_chars", "long").add("output", "string").add("output_sha256", "string"))


def restore(examples: DataFrame) -> DataFrame:
    """``examples`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone, and ``restored_sha256``.

    Neither column may be null or named already; all other columns pass through.
    """
    return examples.mapInArrow(_restore, T.StructType(list(examples.schema)).add("restored", "string").add("restored_sha256", "string"))

"""Fill-in-middle transformation (operator 13) by in-place block rotation.

A document is cut at two code points into prefix, middle and suffix, and is rewritten so that a model sees both ends before
it has to write the middle. The work is done in one bytearray: cuts are scanned to byte places, a sentinel goes before
each segment (``<P>prefix<M>middle<S>suffix``), and neighbouring blocks change places by three reversals:

* prefix-suffix-middle (``psm``): the blocks ``<M>middle`` and ``<S>suffix`` are exchanged;
* suffix-prefix-middle (``spm``): ``<S>suffix`` is exchanged with everything before it.

Restoring finds the sentinels, rotates the blocks back and cuts the sentinels out. A text that holds a sentinel stays
plain, so each sentinel of an output is one that was inserted: a false one could neither lie inside a segment nor
overlap a true one, since it would have to share an angle bracket with it.

Both directions are scalar Arrow functions of columns: rows stay where they are, nothing is shuffled, and the other
columns of a table never enter Python. Beyond the batch, memory is three times the longest text.

Defined results: a null text counts as the empty one and is plain; a null id hashes as the text ``null``; repeated rows
are cut alike; no rows give no rows; input columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symtab.llm.common import without

# The sentinels, and the shares of plain documents and of the suffix-first form in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20
#: Bytes that a reversal holds beside the array.
STEP = 1 << 16


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverses view[start:end] in place: steps of the left end change places with steps of the right end."""
    while end - start > 1:
        n = min(STEP, (end - start) // 2)
        left = view[start : start + n].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(view: np.ndarray, start: int, cut: int, end: int) -> None:
    """Exchanges the blocks view[start:cut] and view[cut:end]: each is reversed, then both together."""
    reverse(view, start, cut)
    reverse(view, cut, end)
    reverse(view, start, end)


def byte_place(view: np.ndarray, at: int, since: int = 0) -> int:
    """Byte at which code point ``at`` (counted from byte ``since``) begins; the array's length if there is none."""
    while since < len(view):
        heads = np.flatnonzero((view[since : since + STEP] & 0xC0) != 0x80)
        if at < len(heads):
            return since + int(heads[at])
        at -= len(heads)
        since += STEP
    return len(view)


def draw(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits from the id alone."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def transform(text: bytes, doc_id: int | None, seed: str) -> tuple[bytes, int, str, int | None, int | None]:
    """(output, code points, form, code points of the prefix, of the middle)."""
    view = np.frombuffer(text, np.uint8)
    n = int(np.count_nonzero((view & 0xC0) != 0x80))
    h1, h2, h3, h4 = draw(doc_id, seed)
    if not n or h3 % 100 >= FIM_PERCENT or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return text, n, "plain", None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = byte_place(view, first)
    b = byte_place(view, second - first, a)
    buffer = bytearray(text)
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
    rotate(np.frombuffer(buffer, np.uint8), middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer), n, form, first, second - first


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    suffix = buffer.index(SUFFIX)
    if form == "psm":  # <P>prefix<S>suffix<M>middle
        start, cut = suffix, buffer.index(MIDDLE)
    else:  # <S>suffix<P>prefix<M>middle
        start, cut = suffix, buffer.index(PREFIX)
    rotate(np.frombuffer(buffer, np.uint8), start, cut, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):  # from the right: each is where it was inserted
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def raw(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def utf8(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).cast(pa.string())


def transformed(id_col: Column, text: Column, seed: str) -> Column:
    """Struct of output, n, form, prefix_chars and middle_chars."""

    @F.arrow_udf("output string, n long, form string, prefix_chars long, middle_chars long")
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [transform(t, i, seed) for i, t in zip(ids.to_pylist(), raw(texts), strict=True)]
        output, *others = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([utf8(output), *(pa.array(x, k) for x, k in zip(others, kinds, strict=True))], names=["output", "n", "form", "prefix_chars", "middle_chars"])

    return run(id_col.cast("long"), text)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form came from."""

    @F.arrow_udf("string")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return utf8([restore(x, f) for x, f in zip(raw(outputs), forms.to_pylist(), strict=True)])

    return run(output, form)


def fill_in_middle(docs: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus output, n, form (plain, psm, spm), prefix_chars and middle_chars (null where plain)."""
    docs = docs.select(F.struct("*").alias("row"), transformed(F.col(id_col), F.col(text_col), seed).alias("fim"))
    plain = docs.select("row.*")
    kept = without(plain, "output", "n", "form", "prefix_chars", "middle_chars").columns
    return docs.select(*(F.col("row").getField(c).alias(c) for c in kept), "fim.*")


def undo(docs: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` returned, plus ``restored``."""
    return without(docs, "restored").withColumn("restored", restored(F.col("output"), F.col("form")))

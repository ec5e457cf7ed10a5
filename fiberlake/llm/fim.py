"""Fill-in-middle transformation: texts cut into prefix, middle and suffix and put in another order.

Cuts fall between units: runs of ASCII letters, or single other characters. Texts stay
UTF-8 bytes throughout. A sparse index of exceptions (``Exceptions``) keeps only the
characters of more than one byte: where each begins, and how many bytes more than
characters there are up to it. A binary search of it turns byte cuts into code-point
cuts and back; in ASCII spans both differ by a constant, so an ASCII text has no entries.

Units are counted in blocks of bytes, so beside the text itself only the exceptions are
kept. Which cuts and which form a document takes follows from a hash of seed and id alone, so
reruns and repartitioned inputs agree.

Nulls: a null text is empty; a null id has an empty decimal form, so such rows take the
cuts of that. Empty texts, and texts that hold a mark already, stay plain. Texts may be
of any length; bytes that are no valid UTF-8 are cut and put back as they are. Repeated
rows give repeated rows. Columns of other names are not looked at. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .bytescan import released

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_INSIDE = np.zeros(256, bool)
_INSIDE[0x80:0xC0] = True  # bytes that continue a character


class Exceptions:
    """The characters of more than one byte in a run of UTF-8 bytes.

    ``at`` is the byte where each begins and ``upto`` how many bytes it and those before
    it have beyond one each.
    """

    def __init__(self, buf: np.ndarray, block: int = 1 << 20):
        at, extra = [], []
        for lo in range(0, len(buf), block):
            at.append(np.flatnonzero(buf[lo : lo + block] >= 0xC0) + lo)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        # bytes that continue a character, up to four at a time
        for k in range(1, 4):
            here = self.at + k
            ok = here < len(buf)
            hit = np.zeros(len(here), bool)
            hit[ok] = _INSIDE[buf[here[ok]]]
            extra.append(hit if k == 1 else extra[-1] & hit)
        self.upto = np.cumsum(sum(x.astype(np.int64) for x in extra)) if extra else np.zeros(0, np.int64)

    def _excess(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, self.upto[np.maximum(n, 1) - 1], 0) if len(self.at) else np.zeros_like(n)

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before byte cuts, which must stand between characters."""
        cut = np.asarray(cut, np.int64)
        return cut - self._excess(np.searchsorted(self.at, cut, "left"))

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Byte cuts before which so many code points stand."""
        cut = np.asarray(cut, np.int64)
        if not len(self.at):
            return cut
        begins = self.at - np.append(0, self.upto[:-1])  # in code points
        return cut + self._excess(np.searchsorted(begins, cut, "left"))


def _starts(buf: np.ndarray, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Where units begin among the bytes ``lo`` to ``hi``; a unit begins with every row too."""
    part = buf[lo:hi]
    letter = _LETTER[part]
    begin = ~_INSIDE[part]
    begin[1:] &= ~(letter[1:] & letter[:-1])
    if lo and letter[:1].any() and _LETTER[buf[lo - 1]]:
        begin[0] = False
    own = rows[np.searchsorted(rows, lo) : np.searchsorted(rows, hi)]
    begin[own - lo] = True
    return np.flatnonzero(begin) + lo


def count_units(buf: np.ndarray, offs: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Units of all rows before each of ``offs``."""
    rows, out, n = offs[offs < len(buf)], np.zeros(len(offs), np.int64), 0
    for lo in range(0, len(buf), block):
        hi = min(len(buf), lo + block)
        s = _starts(buf, rows, lo, hi)
        a, b = np.searchsorted(offs, lo, "left"), np.searchsorted(offs, hi, "left")
        out[a:b] = n + np.searchsorted(s, offs[a:b])
        n += len(s)
    out[offs >= len(buf)] = n
    return out


def unit_places(buf: np.ndarray, offs: np.ndarray, ranks: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Bytes at which the units of these numbers, counted over all rows, begin; the end for others."""
    rows, out, n = offs[offs < len(buf)], np.full(len(ranks), len(buf), np.int64), 0
    order = np.argsort(ranks, kind="stable")
    sorted_ = ranks[order]
    for lo in range(0, len(buf), block):
        s = _starts(buf, rows, lo, min(len(buf), lo + block))
        a, b = np.searchsorted(sorted_, [n, n + len(s)])
        out[order[a:b]] = s[sorted_[a:b] - n]
        n += len(s)
    return out


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, null as empty, and the rows' offsets in them."""
    a = pc.fill_null(column, b"").cast(pa.large_binary())
    _, off, data = a.buffers()
    offs = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def _pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    offs, at = _column(batch.column(column))[1], 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == PLAIN:
        return prefix + middle + suffix
    if form == PSM:
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def rebuild(form: str, output: bytes) -> bytes:
    """The text of an output. Marks cannot arise where a part meets a mark, so the first of each is the right one."""
    if form == PLAIN:
        return output
    second, third = (SUFFIX, MIDDLE) if form == PSM else (PREFIX, MIDDLE)
    if not output.startswith(PREFIX if form == PSM else SUFFIX):
        raise ValueError("no mark at the start")
    a = output.index(second, 3)
    b = output.index(third, a + 3)
    one, two, middle = output[3:a], output[a + 3 : b], output[b + 3 :]
    return one + middle + two if form == PSM else two + middle + one


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row; ``output`` are UTF-8 bytes.

    ``n`` counts units, ``rate`` of 100 documents are cut, ``spm_rate`` of 100 of those give the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *draws, F.col(text_col).cast("binary").alias("text"))

    def cut(batches):
        for batch in batches:
            for part in _pieces(batch, 5):
                yield _cut(part, rate, spm_rate)

    return rows.mapInArrow(released(cut), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def _cut(part: pa.RecordBatch, rate: int, spm_rate: int) -> pa.RecordBatch:
    buf, offs = _column(part.column(5))
    h1, h2, h3, h4 = (part.column(i).to_numpy() for i in range(1, 5))
    before = count_units(buf, offs)
    n = np.diff(before)
    a, b = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    places = unit_places(buf, offs, np.concatenate([before[:-1] + a, before[:-1] + b]))
    first, second = np.where(a < n, places[: len(n)], offs[1:]), np.where(b < n, places[len(n) :], offs[1:])
    index = Exceptions(buf)
    begin, upto, middle = index.chars(offs[:-1]), index.chars(first), index.chars(second)
    raw = buf.tobytes()
    forms, outputs = [], []
    for i, (lo, p, q, hi) in enumerate(zip(offs[:-1].tolist(), first.tolist(), second.tolist(), offs[1:].tolist())):
        text = raw[lo:hi]
        plain = lo == hi or h3[i] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
        forms.append(PLAIN if plain else SPM if h4[i] % 100 < spm_rate else PSM)
        outputs.append(text if plain else arrange(forms[-1], raw[lo:p], raw[p:q], raw[q:hi]))
    plain = np.array([f == PLAIN for f in forms], bool)
    columns = [part.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(upto - begin, pa.int64(), mask=plain), pa.array(middle - upto, pa.int64(), mask=plain), pa.array(outputs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs(.., form, output)`` with ``restored``, the texts' bytes, read from the outputs alone."""
    kept = [c for c in outputs.columns if c not in ("form", "output", "restored")]
    rows = outputs.select(*[F.col(f"`{c}`") for c in kept], "form", "output")

    def read(batches):
        for batch in batches:
            for part in _pieces(batch, len(kept) + 1):
                texts = [rebuild(f, o) for f, o in zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "restored"])

    return rows.mapInArrow(released(read), StructType([*rows.schema.fields]).add("restored", BinaryType()))

"""Fill-in-middle transformation by displacement scatter.

A text is cut into units (a run of A-Z, a-z letters, or one other code point).  Two cuts,
drawn from a digest of ``doc_id``, give prefix, middle and suffix, and the output is

    psm      <P>prefix<S>suffix<M>middle
    spm      <S>suffix<P>prefix<M>middle
    plain    the text

The work is done on the UTF-8 bytes of a whole Arrow batch at once, without a loop over rows:

1. *Scan.*  A mask marks the bytes that begin a unit; its running count finds the byte of each cut.
2. *Displace.*  The three parts of a row move as blocks.  A difference array holds, at the first
   byte of each block, how much the output shift changes there; its cumulative sum is the
   shift of every byte.
3. *Scatter.*  ``out[byte + shift] = text[byte]``; the markers are written at their fixed places.
4. *Inverse.*  ``restore`` finds the markers of each output, derives the same difference array
   from them, and gathers every byte back: it uses the output and the form only.

Steps run over blocks of ``BLOCK`` bytes, with the running sums carried from block to block, so
the working memory is a few bytes per byte of ``BLOCK`` besides the texts and outputs themselves.
No shuffle: one pass over the documents.

Defined results: a null text is an empty one, so its output is empty and plain; a text with a
marker in it is plain (so markers of an output are always its own); a row without ``doc_id`` has
no draw and is plain; the cuts may be equal or at either end (empty parts); equal rows get equal
outputs; texts of any length are cut whole; an empty table gives an empty table; extra columns
pass through, except that columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared_keys, wordhash

PLAIN, PSM, SPM = "plain", "psm", "spm"
MARKERS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT = 10            # of the drawn rows stay plain
SPM_PERCENT = 20              # of the transformed rows put the suffix first
BLOCK = 1 << 20
_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_FORMS = np.array([PLAIN, PSM, SPM])
_MARK = np.array([[ord(c) for c in m] for m in MARKERS], dtype=np.uint8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _unit_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the bytes that begin a unit."""
    letter = _LETTER[buf]
    begins = (buf & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    edge = offsets[:-1]
    begins[edge[edge < len(buf)]] = True
    return begins


def _counts_at(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set bytes of ``mask`` before each of the ascending positions ``at``."""
    out = np.empty(len(at), dtype=np.int64)
    before = 0
    lo = 0
    for a in range(0, max(len(mask), 1), BLOCK):
        part = mask[a:a + BLOCK]
        hi = int(np.searchsorted(at, a + len(part), "left")) if a + BLOCK < len(mask) else len(at)
        run = np.concatenate([[0], np.cumsum(part, dtype=np.int64)])
        out[lo:hi] = before + run[at[lo:hi] - a]
        before += int(run[-1])
        lo = hi
    return out


def _positions_of(mask: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the set bytes with the ascending ranks ``rank`` (0 is the first)."""
    out = np.empty(len(rank), dtype=np.int64)
    before = lo = 0
    for a in range(0, len(mask), BLOCK):
        found = np.flatnonzero(mask[a:a + BLOCK])
        hi = int(np.searchsorted(rank, before + len(found), "left"))
        out[lo:hi] = found[rank[lo:hi] - before] + a
        before += len(found)
        lo = hi
    return out


def _shifts(begin: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, shift of every byte) by blocks, of a piecewise constant shift: ``shift[k]`` from ``begin[k]`` on.

    The difference array of a block gets ``shift[k] - shift[k - 1]`` at ``begin[k]``; of pieces that
    begin at one byte (empty ones before it) all differences add up, so the last holds."""
    step = np.diff(shift, prepend=0)
    carry, lo = 0, 0
    for a in range(0, size, BLOCK):
        b = min(size, a + BLOCK)
        hi = int(np.searchsorted(begin, b, "left"))
        difference = np.zeros(b - a, dtype=np.int64)
        np.add.at(difference, begin[lo:hi] - a, step[lo:hi])
        difference[0] += carry
        run = np.cumsum(difference)
        yield a, b, run
        carry, lo = int(run[-1]), hi


def _marked(buf: np.ndarray, offsets: np.ndarray, marker: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of a marker in the rows' bytes."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, letter, closes = _MARK[marker]
    at = np.flatnonzero((buf[:-2] == opens) & (buf[1:-1] == letter) & (buf[2:] == closes))
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + 3 <= offsets[row + 1]
    return at[whole], row[whole]


def _has_marker(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row's text holds a marker."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    for k in range(3):
        out[_marked(buf, offsets, k)[1]] = True
    return out


def _placed(form: np.ndarray, parts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of prefix, middle and suffix, places of the three markers) in the output, per row.

    ``parts`` are the byte lengths of prefix, middle and suffix, ``begin`` the row's first output byte."""
    prefix, middle, suffix = parts.T
    marked = form > 0
    spm = form == 2
    at = np.empty((len(form), 3), dtype=np.int64)
    mark = np.empty((len(form), 3), dtype=np.int64)
    mark[:, 0] = begin + np.where(spm, 3 + suffix, 0)
    mark[:, 1] = begin + np.where(spm, 0, 3 + prefix)
    mark[:, 2] = begin + 6 + prefix + suffix
    at[:, 0] = np.where(marked, mark[:, 0] + 3, begin)
    at[:, 2] = np.where(marked, mark[:, 1] + 3, begin + prefix + middle)
    at[:, 1] = np.where(marked, mark[:, 2] + 3, begin + prefix)
    return at, mark


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _transform(batch: pa.RecordBatch) -> pa.RecordBatch:
    buf, offsets = wordhash.utf8(batch.column("text"))
    draws = [batch.column(f"_h{k}").fill_null(0).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
    starts = _unit_starts(buf, offsets)
    unit = _counts_at(starts, offsets)
    n = np.diff(unit)
    size = np.diff(offsets)
    plain = (size == 0) | _has_marker(buf, offsets) | (draws[2] % 100 >= 100 - PLAIN_PERCENT) | batch.column("_h1").is_null().to_numpy(zero_copy_only=False)
    form = np.where(plain, 0, np.where(draws[3] % 100 < SPM_PERCENT, 2, 1))

    first, second = draws[0] % (n + 1), draws[1] % (n + 1)
    cut = np.column_stack([np.minimum(first, second), np.maximum(first, second)])
    place = np.repeat(offsets[1:, None], 2, axis=1)             # a cut behind the last unit is the row's end
    inner = cut < n[:, None]
    place[inner] = _positions_of(starts, (unit[:-1, None] + cut)[inner])

    bounds = np.column_stack([offsets[:-1], place, offsets[1:]])
    parts = np.diff(bounds, axis=1)
    new = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(size + 9 * (form > 0), out=new[1:])
    at, mark = _placed(form, parts, new[:-1])
    out = np.empty(int(new[-1]), dtype=np.uint8)
    for a, b, shift in _shifts(bounds[:, :3].ravel(), (at - bounds[:, :3]).ravel(), len(buf)):
        out[np.arange(a, b) + shift] = buf[a:b]
    marked = form > 0
    for k in range(3):
        out[mark[marked, k][:, None] + np.arange(3)] = _MARK[k]

    chars = np.diff(_counts_at((buf & 0xC0) != 0x80, bounds.ravel()).reshape(-1, 4), axis=1)
    lengths = [pa.array(chars[:, k], pa.int64(), mask=~marked) for k in (0, 1)]
    added = [pa.array(n), pa.array(_FORMS[form], pa.string()), *lengths, _strings(out, new)]
    kept = [c for c in batch.schema.names if not c.startswith("_h")]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, names=[*kept, *_ADDED])


def _restore(output: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts, from outputs and forms alone."""
    buf, offsets = wordhash.utf8(output)
    form = pa.compute.index_in(forms.fill_null(PLAIN), pa.array(_FORMS)).to_numpy(zero_copy_only=False)
    mark = np.repeat(offsets[:-1, None], 3, axis=1)
    for k in range(3):                                          # the one marker of its kind in each transformed row
        at, row = _marked(buf, offsets, k)
        mark[row[form[row] > 0], k] = at[form[row] > 0]
    end = offsets[1:]
    spm = form == 2
    begin = mark + 3
    parts = np.column_stack([np.where(spm, mark[:, 2], mark[:, 1]) - begin[:, 0], end - begin[:, 2],
                             np.where(spm, mark[:, 0], mark[:, 2]) - begin[:, 1]])
    plain = form == 0
    parts[plain] = 0
    parts[plain, 0] = np.diff(offsets)[plain]
    begin[plain] = offsets[:-1][plain, None]
    old = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(parts.sum(axis=1), out=old[1:])
    text_at = old[:-1, None] + np.column_stack([np.zeros(len(form), np.int64), parts[:, 0], parts[:, 0] + parts[:, 1]])
    text = np.empty(int(old[-1]), dtype=np.uint8)
    for a, b, shift in _shifts(text_at.ravel(), (begin[:, [0, 2, 1]] - text_at).ravel(), len(text)):
        text[a:b] = buf[np.arange(a, b) + shift]
    return _strings(text, old)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n (units), form, prefix_chars, middle_chars and output."""
    docs = docs.drop(*_ADDED, "_h1", "_h2", "_h3", "_h4")
    digest = F.sha2(F.concat(F.lit("1:"), F.col("doc_id").cast("string")), 256)
    drawn = docs.withColumns({f"_h{k}": F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint") for k in (1, 2, 3, 4)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += ", n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return drawn.mapInArrow(lambda it: (_transform(part) for part in shared_keys.slices(it)), schema)


def restore(made: DataFrame, to: str = "restored") -> DataFrame:
    """Rows with ``output`` and ``form`` get the text they came from as column ``to``."""
    made = made.drop(to)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields) + f", `{to}` string"

    def run(batches):
        for part in shared_keys.slices(batches, "output"):
            yield pa.RecordBatch.from_arrays([*part.columns, _restore(part.column("output"), part.column("form"))],
                                             names=[*part.schema.names, to])

    return made.mapInArrow(run, schema)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document: units, form, lengths of prefix and middle, digests of output and restored text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = restore(fill_in_middle(docs).drop("text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
         sha256('1:' || doc_id) as h from documents),
nums as (
  select doc_id, text, u, len(u) as n, ('0x' || h[1:8])::ubigint::bigint as h1, ('0x' || h[9:16])::ubigint::bigint as h2,
         ('0x' || h[17:24])::ubigint::bigint as h3, ('0x' || h[25:32])::ubigint::bigint as h4 from drawn),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as c, greatest(h1 % (n + 1), h2 % (n + 1)) as d,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form from nums),
parts as (
  select *, array_to_string(u[1:c], '') as p, array_to_string(u[c + 1:d], '') as m, array_to_string(u[d + 1:n], '') as s from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(case when form = 'plain' then text else p || m || s end) as restored_sha256
from parts
"""

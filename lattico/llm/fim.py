"""Fill-in-middle: texts cut at token boundaries into prefix, middle and suffix, and put together in another order.

A batch's texts lie one after another in Arrow's UTF-8 buffer, and all of them are cut together: a table gives each byte's class, a
mask of adjacent bytes tells where tokens begin, a running sum that starts anew with each document numbers them, and a binary search
in it finds the bytes of all cuts. Outputs are gathered from the buffer at once, and texts are rebuilt from outputs and forms the
same way, from the places of the three marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Sheltered, _slices, give_back, table

#: Marks before prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS, MARK = PREFIX + SUFFIX + MIDDLE, 3
#: Of 100 texts, so many are transformed, and of 100 transformed ones so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
OTHER, LETTER, WITHIN = 0, 1, 2
#: Class of each byte: an ASCII letter, a byte within a code point, or another that begins one.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[0x80:0xC0] = WITHIN


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a batch's texts, and where each begins; one place more where the last ends. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = column.buffers()[2] if len(column) else None
    data = np.frombuffer(whole, np.uint8)[at[0] : at[-1]] if whole is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def as_strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a token begins at each byte: at a code point that isn't a letter right after a letter of the same text."""
    kind = CLASS[data]
    starts = kind != WITHIN
    starts[1:] &= (kind[1:] != LETTER) | (kind[:-1] != LETTER)
    starts[at[:-1][at[:-1] < len(data)]] = True
    return starts


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each byte, and in all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def mark_places(data: np.ndarray) -> np.ndarray:
    """Where any of the three marks begins, as bytes alone tell: it may reach beyond a text's end."""
    if len(data) < MARK:
        return np.zeros(0, np.int64)
    hit = (data[:-2] == MARKS[0]) & (data[2:] == MARKS[2]) & np.isin(data[1:-1], [MARKS[1], MARKS[4], MARKS[7]])
    return np.flatnonzero(hit)


def holds_mark(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    places = mark_places(data)
    owner = np.searchsorted(at, places, "right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[owner[places + MARK <= at[owner + 1]]] = True
    return out


def gather(source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pieces of source (begin and length, by row and piece) put together: bytes, and where each row begins."""
    ends = np.cumsum(length.ravel())
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total) + np.repeat(begin.ravel() - (ends - length.ravel()), length.ravel())
    return source[where], np.concatenate([[0], np.cumsum(length.sum(axis=1))]).astype(np.int64)


def cut_batch(data: np.ndarray, at: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """n, form, prefix and middle's code points, output and where each output begins, of all texts. h: four numbers for each text."""
    first, end = at[:-1], at[1:]
    seen = running(token_starts(data, at))
    base = seen[first]
    n = seen[end] - base
    ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # the byte where unit k begins is the first with k + 1 begun after it; past the last unit, the text's end
    cuts = np.where(ends < n[:, None], np.searchsorted(seen, base[:, None] + ends + 1, "left") - 1, end[:, None])
    one, two = cuts[:, 0], cuts[:, 1]
    form = np.where((n == 0) | holds_mark(data, at) | (h[:, 2] % 100 >= TRANSFORMED), PLAIN, np.where(h[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM))
    chars = running(CLASS[data] != WITHIN)
    marks, changed, spm = len(data) + MARK * np.arange(3), form != PLAIN, form == SPM
    three = np.full(len(n), MARK) * changed
    swap = lambda a, b: np.where(spm, b, a)
    begin = np.stack([swap(marks[0], marks[1]) + 0 * n, np.where(changed, swap(first, two), first), swap(marks[1], marks[0]) + 0 * n, swap(two, first), marks[2] + 0 * n, one], axis=1)
    length = np.stack([three, np.where(changed, swap(one - first, end - two), end - first), three, swap(end - two, one - first) * changed, three, (two - one) * changed], axis=1)
    out, out_at = gather(np.concatenate([data, np.frombuffer(MARKS, np.uint8)]), begin, length)
    return {"n": n, "form": form, "prefix_chars": chars[one] - chars[first], "middle_chars": chars[two] - chars[one], "output": out, "output_at": out_at}


def join_batch(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of all outputs, rebuilt from outputs and forms: bytes, and where each begins."""
    first, end = at[:-1], at[1:]
    places = mark_places(data)
    owner = np.searchsorted(at, places, "right") - 1
    inside = (places + MARK <= at[owner + 1]) & (form[owner] != PLAIN)
    places, owner = places[inside], owner[inside]
    changed = np.flatnonzero(form != PLAIN)
    if not np.array_equal(owner, np.repeat(changed, 3)):
        raise ValueError("an output of a transformed text holds three marks, one of each kind")
    begin, length = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
    begin[:, 0], length[:, 0] = first, end - first
    a, b, c = places.reshape(-1, 3).T if len(changed) else np.zeros((3, 0), np.int64)
    spm = form[changed] == SPM
    piece = lambda x, y: (x + MARK, y - x - MARK)
    early, late, middle = piece(a, b), piece(b, c), piece(c, end[changed])
    for i in range(2):
        to = begin if i == 0 else length
        to[changed, 0], to[changed, 1], to[changed, 2] = np.where(spm, late[i], early[i]), middle[i], np.where(spm, early[i], late[i])
    return gather(data, begin, length)


def _numbers(id_: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of a SHA-256; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _limited(spark: SparkSession) -> None:
    most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < most <= ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def transform(df: DataFrame, text: str = "text", id_: str = "doc_id", seed: int = 1) -> DataFrame:
    """df without the text, with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    What is done to a row depends on its id and text alone, so repeated rows get equal results and null ids are one id. Null and
    empty texts stay empty and plain. Columns of df with the names added here are replaced; others may have any name. Texts of
    any length are cut whole; a task has a batch of about 1 MB in hand, or one text.
    """
    user = Sheltered(df)
    text, id_ = user.of(text), user.of(id_)
    keep = [c for c in user.inner if c != text]
    _limited(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("__t")), 0).to_pylist()
            for b in _slices(whole, sizes):
                h = np.stack([b.column(f"__h{i}").to_numpy() for i in range(4)], axis=1)
                made = cut_batch(*buffers(b.column("__t")), h)
                plain = made["form"] == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k) for k in keep], pa.array(made["n"]), pa.array(FORMS[made["form"]], pa.string()), *[pa.array(made[k], mask=plain) for k in ("prefix_chars", "middle_chars")], as_strings(made["output"], made["output_at"])],
                    names=[*keep, "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    rows = user.df.select(*keep, F.col(text).cast("string").alias("__t"), *[x.alias(f"__h{i}") for i, x in enumerate(_numbers(F.col(id_), seed))])
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return user.back(rows.mapInArrow(run, f"{types}n long, form string, prefix_chars long, middle_chars long, output string"), "n", "form", "prefix_chars", "middle_chars", "output")


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """df without the output, with restored: the text that transform() was given, from output and form alone.

    A null output is empty, and a null or unknown form plain. An output of a transformed form without its three marks fails the job.
    """
    user = Sheltered(df)
    output, form = user.of(output), user.of(form)
    keep = [c for c in user.inner if c != output]
    _limited(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("__o")), 0).to_pylist()
            for b in _slices(whole, sizes):
                made = join_batch(*buffers(b.column("__o")), b.column("__f").to_numpy())
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], as_strings(*made)], names=[*keep, "restored"])
        give_back()

    code = F.when(F.col(form) == "psm", PSM).when(F.col(form) == "spm", SPM).otherwise(PLAIN).cast("long")
    rows = user.df.select(*keep, F.col(output).cast("string").alias("__o"), code.alias("__f"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return user.back(rows.mapInArrow(run, f"{types}restored string"), "restored")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restore(made.withColumn("output_sha256", F.sha2("output", 256)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))

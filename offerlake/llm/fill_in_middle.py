"""Fill-in-the-middle arrangements of whole texts, in SQL functions only.

A text is an array of its code points (``regexp_extract_all``). Four numbers from the SHA-256 of a seed and the document's id give two
cuts, whether the text is left as it is, and which arrangement it gets; ``slice`` and ``array_join`` build it. So a document's result depends on
its id and text alone, whatever partition it is in. ``restored`` gets the text back from output and form by its sentinels.

A text that holds a sentinel stays plain, so sentinels of the other forms are those that were put there: no sentinel can
arise where a piece meets one, since only its first character is ``<`` and only its last is ``>``.

A null text counts as empty; an empty one is plain. A null id hashes as an empty one. Repeated rows get equal results, row by row; ids of any type that
casts to a string do. Columns of ``docs`` other than id and text are not read; an empty table gives no rows. A text's units take some
70 bytes each while its row is worked on, and no more than one row is at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: The sentinels that begin prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<[PSM]>"


def draws(doc_id: Column, seed: str = "1") -> Column:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    joined = lambda p, *at: F.concat(*[F.get(p, k) for k in at])
    whole = let(F.split(output, SENTINELS, -1), lambda p: F.when(form == "psm", joined(p, 1, 3, 2)).otherwise(joined(p, 2, 3, 1)))
    return F.when(form == "plain", output).otherwise(whole)


def fill_in_middle(docs: DataFrame, *, rate: int = 90, spm_rate: int = 20, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null where plain), output.

    ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of those with the suffix first.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)).alias("units"), draws(F.col(id_col), seed).alias("h"))
    n, h = F.size("units").cast("long"), lambda k: F.get("h", k)
    plain = (n == 0) | F.col("text").rlike(SENTINELS) | (h(2) % 100 >= rate)
    rows = rows.withColumns({
        "n": n, "cut": F.least(h(0) % (n + 1), h(1) % (n + 1)).cast("int"), "end": F.greatest(h(0) % (n + 1), h(1) % (n + 1)).cast("int"),
        "form": F.when(plain, "plain").when(h(3) % 100 < spm_rate, "spm").otherwise("psm"),
    })
    piece = lambda a, b: F.array_join(F.slice("units", a + 1, b - a), "")
    cut, end = F.col("cut"), F.col("end")
    prefix, middle, suffix = piece(F.lit(0), cut), piece(cut, end), piece(end, F.col("n").cast("int"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    own = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return rows.select("doc_id", "n", "form", own(cut).alias("prefix_chars"), own(end - cut).alias("middle_chars"), F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))

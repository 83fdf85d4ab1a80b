"""Column expressions for aligned reads: extent on the reference, base qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CIGAR operations that consume reference bases, the ASCII offset of a quality, the highest quality that
# is still believable, and how far the older encoding is shifted.
REFERENCE_OPS = r"(\d+)[MDN=X]"
QUALITY_OFFSET = 33
HIGHEST_SANGER = 60
ILLUMINA_SHIFT = 31

_SHIFTED = "".join(map(chr, range(QUALITY_OFFSET + ILLUMINA_SHIFT, 127)))
_STANDARD = "".join(chr(ord(c) - ILLUMINA_SHIFT) for c in _SHIFTED)


def alignment_end(start: Column | str, cigar: Column | str) -> Column:
    """Last reference position a read covers."""
    start = F.col(start) if isinstance(start, str) else start
    lengths = F.regexp_extract_all(cigar, F.lit(REFERENCE_OPS), F.lit(1))
    covered = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))
    return start + covered - 1


def _known(qual: Column) -> Column:
    return (qual != "*") & (qual != "")


def quality_encoding(qual: Column | str) -> Column:
    """``sanger`` or ``illumina``, judged by the highest quality of the read; NULL if it has none."""
    qual = F.col(qual) if isinstance(qual, str) else qual
    highest = F.ascii(F.array_max(F.split(qual, ""))) - QUALITY_OFFSET
    return F.when(_known(qual), F.when(highest <= HIGHEST_SANGER, "sanger").otherwise("illumina"))


def fix_quality(qual: Column | str) -> Column:
    """Qualities of the older encoding in the standard one."""
    return F.translate(qual, _SHIFTED, _STANDARD)


def bad_quality(qual: Column | str) -> Column:
    """Whether some quality would fall below 0 when shifted: the read was not in the older encoding after all."""
    qual = F.col(qual) if isinstance(qual, str) else qual
    return _known(qual) & qual.rlike(f"[^{_SHIFTED[0]}-{_SHIFTED[-1]}]")

"""Names of telescopes and backends by their number, and error texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import BAD_CODE, MESSAGES

#: Telescope numbers 0 to 14.
TELESCOPES = (
    "Fake", "Arecibo", "Ooty", "Nancay", "Parkes", "Jodrell", "GBT", "GMRT", "Effelsberg", "ATA", "UTR-2", "LOFAR", "FR606", "DE601", "UK608",
)
NO_TELESCOPE = "???????"
#: Backend numbers.
BACKENDS = {0: "FAKE", 1: "PSPM", 2: "WAPP", 3: "AOFTM", 4: "BPP", 5: "OOTY", 6: "SCAMP", 7: "SPIGOT", 10: "ARTEMIS", 11: "Cobalt"}
NO_BACKEND = "????"


def telescope(number: int) -> str:
    return TELESCOPES[number] if 0 <= number < len(TELESCOPES) else NO_TELESCOPE


def backend(number: int) -> str:
    return BACKENDS.get(number, NO_BACKEND)


def _lookup(number: Column, known: dict[int, str], other: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)])
    return F.coalesce(F.element_at(pairs, number.cast("int")), F.lit(other))


def telescope_name(number: Column) -> Column:
    return _lookup(number, dict(enumerate(TELESCOPES)), NO_TELESCOPE)


def backend_name(number: Column) -> Column:
    return _lookup(number, BACKENDS, NO_BACKEND)


def error_string(code: Column) -> Column:
    return _lookup(code, dict(enumerate(MESSAGES)), BAD_CODE)

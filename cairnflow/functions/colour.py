"""Colour ramps over elevations as Column expressions: r, g, b by linear interpolation between stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Six evenly spaced stops each, as hexadecimal red, green, blue.
_STOPS = {
    "light_terrain": "1C2E23 2B5E40 629456 ABBF7A E3D7A8 F7F2E6",
    "dune": "012E40 3D545C 8C7B62 CFA97E EBD19D F7F4E6",
    "mist": "012F38 115A73 2F8EBD 78BEF0 BDD8FF F0F3FC",
    "iceberg": "112D38 325563 608999 9FB9BF C8DBDE EBF7F7",
}
PALETTES = {name: tuple(tuple(x / 255 for x in bytes.fromhex(c)) for c in line.split()) for name, line in _STOPS.items()}
#: Opacity of the dune stops, where asked for: clear in the middle.
ALPHA = tuple(x / 255 for x in (0xFF, 0x88, 0x11, 0x11, 0x88, 0xFF))


def truncate(stops: tuple, low: float = 0.0, high: float = 1.0, n: int = 256) -> tuple:
    """n levels of the ramp's part between low and high."""
    return tuple(_at(stops, low + (high - low) * k / (n - 1)) for k in range(n))


def _at(stops: tuple, t: float) -> tuple[float, ...]:
    x = min(max(t, 0.0), 1.0) * (len(stops) - 1)
    k = min(int(x), len(stops) - 2)
    return tuple(a + (b - a) * (x - k) for a, b in zip(stops[k], stops[k + 1]))


def colour(value: Column, low: float, high: float, palette: str = "light_terrain", minval: float = 0.0, maxval: float = 1.0, levels: int = 256, reverse: bool = False, alpha: bool = False) -> dict[str, Column]:
    """Columns r, g, b (and the opacity a, as dune has it) of ``value`` between ``low`` and ``high`` at one of ``levels`` steps."""
    stops = PALETTES[palette][::-1] if reverse else PALETTES[palette]
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low) if high > low else F.lit(0.0)))
    step = F.least(F.floor(share * levels), F.lit(levels - 1)) / (levels - 1)
    x = (minval + (maxval - minval) * step) * (len(stops) - 1)
    k = F.least(F.floor(x), F.lit(len(stops) - 2))
    out = {}
    for n, name in enumerate("rgb"):
        table = F.array(*(F.lit(float(s[n])) for s in stops))
        a, b = F.get(table, k.cast("int")), F.get(table, (k + 1).cast("int"))
        out[name] = a + (b - a) * (x - k)
    if alpha:
        table = F.array(*map(F.lit, ALPHA))
        lo, hi = F.get(table, k.cast("int")), F.get(table, (k + 1).cast("int"))
        out["a"] = lo + (hi - lo) * (x - k)
    return out

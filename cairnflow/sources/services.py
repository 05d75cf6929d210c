"""Request builders and caches for two public elevation services.

Nothing is fetched at import; ``fetch`` does one HTTP GET into the cache and is the only part
that needs a network. Secrets are parameters and never logged.
"""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request
import warnings
from dataclasses import dataclass

GMRT_FORMATS = {"netcdf": ".grd", "coards": ".grd", "esriascii": ".asc", "geotiff": ".tif"}
GMRT_RESOLUTIONS = ("default", "low", "med", "high", "max")
OPENTOPO_PRODUCTS = ("SRTMGL3", "SRTMGL1", "SRTMGL1_E", "AW3D30", "AW3D30_E", "SRTM15Plus", "NASADEM", "COP30", "COP90", "EU_DTM", "GEDI_L3", "GEBCOIceTopo", "GEBCOSubIceTopo")
OPENTOPO_FORMATS = {"geotiff": ("GTiff", ".tif"), "esriascii": ("AAIGrid", ".asc"), "erdas": ("HFA", ".img")}


@dataclass
class DataDir:
    """Where downloads are kept; a parameter of every call, not a global."""

    path: str = "data"

    def of(self, service: str) -> str:
        return os.path.join(self.path, service)


def check_limits(latlim: tuple[float, float], lonlim: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """South before north, west before east, longitudes of a full turn; equal limits are an error."""
    out = []
    for name, lim in (("latitude", latlim), ("longitude", lonlim)):
        a, b = lim
        if a == b:
            raise ValueError(f"the {name} limits are equal")
        if a > b:
            warnings.warn(f"the {name} limits are swapped", stacklevel=2)
            a, b = b, a
        out.append((float(a), float(b)))
    (south, north), (west, east) = out
    if south < -90 or north > 90:
        raise ValueError("latitudes lie between -90 and 90")
    turn = (west + 180) // 360 * 360
    return (south, north), (west - turn, east - turn)


def _number(x: float) -> str:
    return f"{x:g}".replace("-", "m").replace(".", "p")


def cache_path(service: str, latlim, lonlim, label: str, extension: str, data: DataDir | None = None) -> str:
    """A file name that says the request: minus as m, point as p; a label below 1 begins with the p."""
    label = label.replace(".", "p")
    label = label[1:] if label.startswith("0p") else label
    name = "_".join([service, label, *(_number(x) for x in (*latlim, *lonlim))])
    return os.path.join((data or DataDir()).of(service), name + extension)


def gmrt_request(latlim, lonlim, resolution: str | float = "default", format: str = "geotiff", base_url: str = "https://www.gmrt.org/services/GridServer") -> str:
    """The URL of one grid; ``resolution`` is a named one or metres."""
    if format not in GMRT_FORMATS:
        raise ValueError(f"format is one of {sorted(GMRT_FORMATS)}")
    (south, north), (west, east) = check_limits(latlim, lonlim)
    query = {"north": north, "south": south, "east": east, "west": west, "layer": "topo", "format": format}
    if isinstance(resolution, str):
        if resolution not in GMRT_RESOLUTIONS:
            raise ValueError(f"resolution is one of {GMRT_RESOLUTIONS} or a number of metres")
        query["resolution"] = resolution
    else:
        if resolution <= 0:
            raise ValueError("the resolution must be positive")
        query["mresolution"] = resolution
    return f"{base_url}?{urllib.parse.urlencode(query)}"


def opentopo_request(latlim, lonlim, api_key: str, product: str = "SRTMGL3", format: str = "geotiff", base_url: str = "https://portal.opentopography.org/API/globaldem") -> str:
    if product not in OPENTOPO_PRODUCTS:
        raise ValueError(f"product is one of {OPENTOPO_PRODUCTS}")
    if format not in OPENTOPO_FORMATS:
        raise ValueError(f"format is one of {sorted(OPENTOPO_FORMATS)}")
    (south, north), (west, east) = check_limits(latlim, lonlim)
    query = {"demtype": product, "south": south, "north": north, "west": west, "east": east, "outputFormat": OPENTOPO_FORMATS[format][0], "API_Key": api_key}
    return f"{base_url}?{urllib.parse.urlencode(query)}"


MEANING = {204: "no data in this area", 400: "the service rejects the request", 401: "the key isn't accepted", 404: "no data for this request", 413: "the area is too large"}


def fetch(url: str, to: str, force: bool = False, timeout: float = 120) -> str:
    """Download into ``to`` unless it is there; returns the path. Errors name their meaning, never the URL's key."""
    if os.path.exists(to) and not force:
        return to
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            if answer.status == 204:
                raise ValueError(MEANING[204])
            body = answer.read()
    except urllib.error.HTTPError as err:
        raise ValueError(MEANING.get(err.code, f"HTTP status {err.code}")) from None
    part = f"{to}.part"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, to)
    return to


def gmrt(spark, latlim, lonlim, resolution="default", format="esriascii", saveas: str | None = None, forcenew: bool = False, data: DataDir | None = None):
    """(cells, transform) of a grid from the first service, through the cache."""
    from .rasters import read_dem

    url = gmrt_request(latlim, lonlim, resolution, format)
    to = saveas or cache_path("gmrt", *check_limits(latlim, lonlim), str(resolution), GMRT_FORMATS[format], data)
    return read_dem(spark, fetch(url, to, forcenew))


def opentopo(spark, latlim, lonlim, api_key: str, product="SRTMGL3", format="esriascii", saveas: str | None = None, forcenew: bool = False, data: DataDir | None = None):
    """(cells, transform) of a grid from the second service, through the cache."""
    from .rasters import read_dem

    url = opentopo_request(latlim, lonlim, api_key, product, format)
    to = saveas or cache_path("opentopo", *check_limits(latlim, lonlim), product, OPENTOPO_FORMATS[format][1], data)
    return read_dem(spark, fetch(url, to, forcenew))

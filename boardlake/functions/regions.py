"""Region labels by location text. A location may belong to several regions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boardlake.functions.text import let

# ---- fixed values: region label -> LIKE patterns over the lower-cased location -------
_STATE_CODES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv "
    "nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy"
).split()
_STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa",
    "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
]
_US_CITIES = [
    "san francisco", "los angeles", "chicago", "houston", "phoenix", "seattle", "denver",
    "boston", "austin", "portland", "atlanta", "miami", "dallas", "san diego", "san jose",
    "philadelphia", "minneapolis",
]


def _anywhere(*names: str) -> list[str]:
    return [f"%{n}%" for n in names]


REGIONS: dict[str, list[str]] = {
    "united kingdom": _anywhere(
        "united kingdom", "uk", "great britain", "england", "scotland", "wales",
        "northern ireland", "london", "manchester", "birmingham", "leeds", "glasgow",
        "edinburgh", "bristol", "liverpool", "cardiff", "belfast", "newcastle",
        "sheffield", "nottingham", "cambridge", "oxford"),
    "united states": (
        ["%united states%", "%, us%", "% us", "%usa%", "%u.s.%"]
        + [f"%, {code}" for code in _STATE_CODES]
        + _anywhere(*_STATE_NAMES, *_US_CITIES)),
    "canada": _anywhere(
        "canada", ", ca", "toronto", "vancouver", "montreal", "ottawa", "calgary",
        "edmonton", "winnipeg", "quebec", "ontario", "british columbia", "alberta",
        "nova scotia"),
    "germany": _anywhere(
        "germany", "deutschland", "berlin", "munich", "münchen", "hamburg", "frankfurt",
        "cologne", "köln", "düsseldorf", "stuttgart"),
    "france": _anywhere("france", "paris", "lyon", "marseille", "toulouse", "bordeaux", "lille"),
    "netherlands": _anywhere(
        "netherlands", "holland", "amsterdam", "rotterdam", "the hague", "utrecht", "eindhoven"),
    "ireland": _anywhere("ireland", "dublin", "cork", "galway", "limerick"),
    "australia": _anywhere(
        "australia", "sydney", "melbourne", "brisbane", "perth", "adelaide", "canberra"),
    "india": _anywhere(
        "india", "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "chennai", "pune",
        "kolkata", "noida", "gurgaon", "gurugram"),
    "spain": _anywhere("spain", "españa", "madrid", "barcelona", "valencia", "seville", "malaga"),
    "italy": _anywhere("italy", "italia", "rome", "roma", "milan", "milano", "turin", "naples"),
    "sweden": _anywhere("sweden", "stockholm", "gothenburg", "malmö"),
    "switzerland": _anywhere(
        "switzerland", "zürich", "zurich", "geneva", "genève", "bern", "basel"),
    "singapore": _anywhere("singapore"),
    "japan": _anywhere("japan", "tokyo", "osaka", "kyoto"),
    "brazil": _anywhere("brazil", "são paulo", "rio de janeiro"),
    "mexico": _anywhere("mexico", "ciudad de méxico", "guadalajara", "monterrey"),
    "poland": _anywhere("poland", "warsaw", "krakow", "kraków", "wroclaw"),
    "portugal": _anywhere("portugal", "lisbon", "lisboa", "porto"),
    "remote / anywhere": _anywhere("remote", "anywhere", "worldwide", "global"),
    "europe": ["%europe%", "%eu %", "% eu", "%european union%", "%emea%"],
}
# --------------------------------------------------------------------------------------


def _like_any(low: Column, patterns: list[str]) -> Column:
    """Catalyst turns constant '%x%' and '%x' patterns into contains and endsWith."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | low.like(p)
    return hit


def region_labels(location: Column, regions: dict[str, list[str]] = REGIONS) -> Column:
    """array<string> of all matching regions, in table order."""
    return let(F.lower(location), lambda low: F.array_compact(
        F.array(*[F.when(_like_any(low, p), F.lit(r)) for r, p in regions.items()])
    ))


def region_filter(location: Column, region: str, regions: dict[str, list[str]] = REGIONS) -> Column:
    """Listings of a region; an unknown label filters nothing."""
    patterns = regions.get(region.lower(), [])
    if not patterns:
        return F.lit(True)
    return let(F.lower(location), lambda low: _like_any(low, patterns))

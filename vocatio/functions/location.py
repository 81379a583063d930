"""Is a free-text location in the United States?  One expression over a whole table.

Each family of literals is one alternation, so that the generated code stays small; the literal
that matched is then looked up.  Of several matching markers the first by alphabet is reported, of
several matching cities the first in the table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocatio.functions.text import SPACES, trimmed

# State codes.
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]

# Cities that need no state, in order of precedence.  "new york" shadows longer names.
CITIES = {
    "san francisco": "CA", "sf": "CA", "new york": "NY", "nyc": "NY",
    "seattle": "WA", "sea": "WA", "chicago": "IL", "chi": "IL", "austin": "TX",
    "denver": "CO", "atlanta": "GA", "los angeles": "CA", "la": "CA", "boston": "MA",
    "miami": "FL", "houston": "TX", "dallas": "TX", "philadelphia": "PA", "phoenix": "AZ",
    "san diego": "CA", "detroit": "MI", "minneapolis": "MN", "charlotte": "NC",
    "nashville": "TN", "pittsburgh": "PA", "san jose": "CA", "oakland": "CA",
    "sacramento": "CA", "salt lake city": "UT", "raleigh": "NC", "orlando": "FL",
    "tampa": "FL", "las vegas": "NV", "washington dc": "DC", "dc": "DC",
}

# Names that place a location elsewhere.
MARKERS = [
    "canada", "toronto", "vancouver", "montreal", "united kingdom", "uk", "london",
    "dublin", "ireland", "france", "paris", "germany", "berlin", "munich", "india",
    "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "pune", "singapore",
    "australia", "sydney", "melbourne", "netherlands", "amsterdam", "mexico",
    "brazil", "sao paulo", "japan", "tokyo", "china", "shanghai",
    "beijing", "spain", "madrid", "barcelona", "poland", "warsaw", "israel",
    "tel aviv", "philippines", "manila", "colombia", "bogota", "argentina",
    "costa rica", "romania", "bucharest", "portugal", "lisbon", "sweden",
    "stockholm", "switzerland", "zurich", "belgium", "brussels", "italy", "milan",
    "rome", "new zealand", "auckland", "korea", "seoul", "taiwan", "taipei",
    "hong kong", "vietnam", "indonesia", "jakarta", "egypt", "cairo", "nigeria",
    "kenya", "nairobi", "south africa", "cape town", "johannesburg",
]

CITY_STATE = r"([A-Za-z .'-]+),\s*([A-Z]{2})(?!-)\b"


def _outcome(is_us: bool, reason: Column, remote: Column, city=None, state=None) -> Column:
    text = lambda v: (F.lit(None) if v is None else v).cast("string")
    return F.struct(
        F.lit(is_us).alias("is_us"),
        reason.alias("reason"),
        (remote if is_us else F.lit(False)).alias("is_remote"),
        text(city).alias("city"),
        text(state).alias("state"),
        text(F.lit("US") if is_us else None).alias("country"),
    )


def classify(raw: Column, word_boundary: bool = False) -> Column:
    """Struct is_us, reason, is_remote, city, state, country.  ``word_boundary``: markers count only
    as whole words (else ``uk`` is found in ``milwaukee``)."""
    low = F.lower(raw)
    remote = F.contains(low, F.lit("remote"))
    markers = "|".join(sorted(MARKERS))
    markers = rf"\b(?:{markers})\b" if word_boundary else markers
    marker_in = lambda c: F.array_min(F.regexp_extract_all(c, F.lit(markers), F.lit(0)))

    segments = F.transform(F.split(raw, "[,;]"), lambda s: F.btrim(s, F.lit(SPACES)))
    prefixed = F.get(F.filter(segments, lambda s: s.rlike("^[A-Z]{2}-")), F.lit(0))
    code = F.substring(prefixed, 1, 2)
    place = F.lower(trimmed(F.substring(prefixed, 4, 10_000)))

    pair_state = F.regexp_extract(raw, CITY_STATE, 2)
    pair_city = trimmed(F.regexp_extract(raw, CITY_STATE, 1))
    marker = marker_in(low)

    names = list(CITIES)
    rank = F.create_map(*[F.lit(x) for pair in zip(names, range(1, len(names) + 1)) for x in pair])
    hits = F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b"), F.lit(1))
    best = F.array_min(F.transform(hits, lambda h: rank[h]))
    city = F.get(F.array(*map(F.lit, names)), best - 1)
    city_state = F.get(F.array(*[F.lit(CITIES[n]) for n in names]), best - 1)
    token = F.get(F.filter(F.split(raw, "[^A-Za-z]+"), lambda t: t.isin(STATES)), F.lit(0))

    joined = lambda head, tail: F.concat(F.lit(head), tail)
    return (
        F.when(raw.isNull() | (trimmed(raw) == ""), _outcome(False, F.lit("no_location_data"), remote))
        .when(code == "US", _outcome(True, F.lit("us_prefix_segment"), remote))
        .when(marker_in(place).isNotNull(), _outcome(False, joined("non_us_prefix_segment:", F.lower(code)), remote))
        .when(code.isin(STATES), _outcome(True, joined("state_prefix_segment:", code), remote, state=code))
        .when(pair_state.isin(STATES), _outcome(True, joined("city_state_pattern:", pair_state), remote, pair_city, pair_state))
        .when(F.contains(low, F.lit("united states")), _outcome(True, F.lit("country_name_match"), remote))
        .when(low.rlike(r"\busa\b"), _outcome(True, F.lit("country_abbreviation_match:usa"), remote))
        .when(marker.isNotNull(), _outcome(False, joined("non_us_location_match:", marker), remote))
        .when(raw.rlike(r"\bUS\b"), _outcome(True, F.lit("us_token_match"), remote))
        .when(best.isNotNull(), _outcome(True, joined("unambiguous_city_match:", city), remote, F.initcap(city), city_state))
        .when(token.isNotNull(), _outcome(True, joined("state_abbreviation_token:", token), remote, state=token))
        .when(remote, _outcome(False, F.lit("ambiguous_remote_no_country_cue"), remote))
        .otherwise(_outcome(False, F.lit("undetermined_scope"), remote))
    )

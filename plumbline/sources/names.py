"""Metadata carried by file names and identifiers, as column expressions."""

from pyspark.sql import functions as F

# <site>[_]<type>_<instrument>[_<suffix>]_<yyyymmdd>[_<suffix>].csv
# or <yyyymmdd>_<instrument>_<site>[_]<type>[_<suffix>].csv
NAME_FIRST = r"^([A-Z]+\d+)_?([A-Z])_([A-Za-z]+)(?:_([A-Za-z0-9]+))?_(\d{8})(?:_([A-Za-z0-9]+))?\.csv$"
DATE_FIRST = r"^(\d{8})_([A-Za-z]+)_([A-Z]+\d+)_?([A-Z])(?:_([A-Za-z0-9]+))?\.csv$"
WELL_ID = r"^([A-Za-z]+\d+)([A-Za-z]?)$"
ERT_NAME = r"^(.*)_x_(-?\d+(?:\.\d+)?)\.csv$"


def parse_cast_name(name, patterns=(NAME_FIRST, DATE_FIRST)):
    """site, well_type, instrument, cast_date, suffix, well_id; all null when neither fits.

    A suffix may stand before or after the date; the one before it counts if both do.
    """
    first, second = patterns

    def pick(*places):
        return F.coalesce(*[F.nullif(F.regexp_extract(name, p, group), F.lit("")) for p, group in places])

    site, kind = pick((first, 1), (second, 3)), pick((first, 2), (second, 4))
    return {
        "site": site, "well_type": kind, "instrument": pick((first, 3), (second, 2)),
        "suffix": pick((first, 4), (first, 6), (second, 5)), "cast_date": pick((first, 5), (second, 1)),
        "well_id": F.concat(site, kind),
    }


def split_well_id(well_id, pattern=WELL_ID):
    """(site, trailing type letter or empty)."""
    return F.regexp_extract(well_id, pattern, 1), F.regexp_extract(well_id, pattern, 2)


def well_of_source(source_file):
    """The token before the first underscore."""
    return F.split_part(source_file, F.lit("_"), F.lit(1))


def parse_ert_name(name, pattern=ERT_NAME):
    """(variant, x), split at the last `_x_`."""
    return (
        F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")),
        F.regexp_extract(name, pattern, 2).try_cast("double"),
    )

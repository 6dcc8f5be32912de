"""Element text and catalogue CSV: written from the tables and read back."""

import uuid

from pyspark.sql import functions as F

from orbitframe.plans.adapters import oracle, view
from orbitframe.plans.compare import plain, r6
from orbitframe.plans.query import Query
from orbitframe.sources import element_text, sinks
from orbitframe.sources.landing import shared_folder

_TURNED = "(({0}) % 360e0 + 360e0) % 360e0"
# what eight digits of a day leave of an instant, cut to milliseconds
_YEAR_MS = "epoch_ms(date_trunc('year', epoch_ms(epoch_utc)))"
_HELD_MS = (f"{_YEAR_MS} + CAST(floor(round((round(1 + (epoch_utc - {_YEAR_MS}) / 86400000e0, 8) - 1)"
            " * 86400e6) / 1000e0) AS BIGINT)")
_FIELDS = ["incl_deg", "raan_deg", "ecc", "argp_deg", "mean_anom_deg", "revs_per_day"]


def _folder(s):
    return f"{shared_folder(s)}/text-{uuid.uuid4().hex}"


def _lines(s, d, name="history"):
    return sinks.element_lines(view(s, d, name))


def _text(s, d):
    folder = _folder(s)
    names = view(s, d, "satcat").select("norad_id", "name")
    sinks.write_element_text(_lines(s, d).drop("name").join(names, "norad_id", "left"), folder)
    return element_text.read_element_text(s, folder, "live")


def _csv(s, d):
    folder = _folder(s)
    sinks.write_satcat_csv(view(s, d, "satcat"), folder)
    return element_text.read_satcat_csv(s, folder)


_HELD = f"""SELECT norad_id, {_HELD_MS} AS epoch, {r6('incl_deg', digits=4)},
    {r6(_TURNED.format('raan_deg'), 'raan_deg', 4)}, {r6('ecc', digits=7)},
    {r6(_TURNED.format('argp_deg'), 'argp_deg', 4)},
    {r6(_TURNED.format('mean_anom_deg'), 'mean_anom_deg', 4)}, {r6('revs_per_day', digits=8)}"""


def _elements(df, *more):
    return plain(df.select("norad_id", "epoch", *_FIELDS, *more), digits=8)


QUERIES = {
    "read_element_text": Query(
        lambda s, d: _elements(_text(s, d), "source"),
        oracle(["history"], f"{_HELD}, 'live' AS source FROM history")),
    "decode_elements": Query(
        lambda s, d: _elements(element_text.decode_elements(_lines(s, d).select("line1", "line2"))),
        oracle(["history"], f"{_HELD} FROM history")),
    "decode_element_epoch": Query(
        lambda s, d: plain(sinks.element_lines(view(s, d, "history").withColumn(
            "epoch", F.col("epoch") + F.make_ym_interval(-(F.col("norad_id") % 60).cast("int")))).select(
                "norad_id", element_text.decode_epoch().alias("epoch"))),
        oracle(["history"], f"""
            WITH moved AS (SELECT norad_id, epoch_ms(epoch_ms(epoch_utc)
                - to_years(CAST(norad_id % 60 AS INTEGER))) AS epoch_utc FROM history)
            SELECT norad_id, {_HELD_MS} AS epoch FROM moved""")),
    "read_satcat_csv": Query(
        lambda s, d: plain(_csv(s, d)),
        oracle(["satcat"], f"""SELECT norad_id, intl_desig, name, nullif(country, '') AS country,
            CAST(launch_date AS STRING) AS launch_date, CAST(decay_date AS STRING) AS decay_date,
            object_type, {r6('rcs_m2')}, {r6('period_min')}, {r6('inclination')}, {r6('apogee_km')},
            {r6('perigee_km')} FROM satcat""")),
}

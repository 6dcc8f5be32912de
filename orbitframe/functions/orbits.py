"""Column expressions for orbits: shape, regimes, special orbits, disposal."""

from functools import reduce

from pyspark.sql import Column, functions as F

from orbitframe import constants as K

TWO_PI = 6.283185307179586


def lit(value) -> Column:
    return F.lit(value)


# ---------------------------------------------------------------- shape
def mean_motion_rad_s(revs_per_day: Column) -> Column:
    return revs_per_day * lit(TWO_PI) / lit(86400.0)


def semi_major_km(mean_motion: Column) -> Column:
    return F.pow(lit(K.MU_KM3_S2) / (mean_motion * mean_motion), lit(1.0 / 3.0))


def period_min(mean_motion: Column) -> Column:
    return lit(TWO_PI) / mean_motion / lit(60.0)


# ---------------------------------------------------------------- ladders
def coarse_regime(apogee, perigee, incl, ecc) -> Column:
    """Element-based coarse tag; the first rule that holds wins."""
    return (
        F.when(apogee < 2000, "LEO")
        .when((perigee > 34000) & (apogee < 38000) & (ecc < 0.05), "GEO")
        .when((perigee < 2000) & (apogee > 30000), "GTO/HEO")
        .when((ecc > 0.5) & (incl > 60) & (incl < 70), "MOLNIYA")
        .when((perigee >= 2000) & (apogee <= 34000), "MEO")
        .otherwise("OTHER")
    )


def satcat_regime(apogee, perigee) -> Column:
    """Catalogue-based band; a dash when the orbit is not published."""
    return (
        F.when(apogee.isNull() | perigee.isNull(), "—")
        .when(apogee < 2000, "LEO")
        .when((perigee >= 2000) & (apogee < 34000), "MEO")
        .when(apogee.between(34000, 38000) & (perigee > 33000), "GEO")
        .when((apogee > 35000) & (perigee < 2000), "HEO")
        .otherwise("OTHER")
    )


def band_predicate(band: str, apogee="apogee_km", perigee="perigee_km") -> Column:
    """Named altitude predicate; bands may overlap."""
    apo, per = F.col(apogee), F.col(perigee)
    rules = {
        "LEO": apo < 2000,
        "MEO": (per >= 2000) & (apo < 34000),
        "GEO": apo.between(34000, 38000) & (per > 33000),
        "HEO": (apo > 35000) & (per < 2000),
        "GRAVEYARD": per > 35936,
    }
    return rules[band]


BANDS = ("LEO", "MEO", "GEO", "HEO", "GRAVEYARD")


def required_sso_inclination(semi_major, ecc) -> Column:
    """Inclination whose J2 node drift follows the Sun; NULL if none does."""
    rate = F.sqrt(lit(K.MU_KM3_S2) / (semi_major * semi_major * semi_major))
    semi_latus = semi_major * (1 - ecc * ecc)
    ratio = lit(K.R_EARTH_KM) / semi_latus
    cos_i = -lit(K.SUN_RATE_RAD_S) / (rate * lit(1.5 * K.J2) * ratio * ratio)
    return F.when(cos_i.between(-1.0, 1.0), F.degrees(F.acos(cos_i)))


def _near_period(period, target_min) -> Column:
    return F.abs(period - lit(target_min)) / lit(target_min) <= K.PERIOD_TOLERANCE


def tag_conditions(semi_major, ecc, incl, apogee, period) -> dict[str, Column]:
    """Tag name -> condition, in reporting order."""
    sso_incl = required_sso_inclination(semi_major, ecc)
    sso = F.coalesce(
        (F.abs(incl - sso_incl) <= K.SSO_TOLERANCE_DEG) & (apogee < 2000), lit(False)
    )
    frozen = (F.abs(incl - K.CRITICAL_INCL_DEG) <= K.CRITICAL_TOLERANCE_DEG) & (ecc > 0.15)
    half = _near_period(period, K.SIDEREAL_DAY_S / 2 / 60.0)
    full = _near_period(period, K.SIDEREAL_DAY_S / 60.0)
    polar = incl.between(K.POLAR_MIN_DEG, K.POLAR_MAX_DEG)
    return {
        "SSO": sso,
        "MOLNIYA": frozen & half,
        "TUNDRA": frozen & ~half & full,
        "RETROGRADE": (incl > 90) & ~sso,
        "POLAR": polar,
        "EQUATORIAL": ~polar & (incl <= K.EQUATORIAL_MAX_DEG),
    }


def special_orbit_tags(semi_major, ecc, incl, apogee, period) -> Column:
    conditions = tag_conditions(semi_major, ecc, incl, apogee, period)
    return F.array_compact(F.array(*[F.when(c, lit(t)) for t, c in conditions.items()]))


def at_critical_period(ecc, incl, period) -> Column:
    """Frozen-apogee orbit of half or one sidereal day."""
    return (F.abs(incl - K.CRITICAL_INCL_DEG) <= K.CRITICAL_TOLERANCE_DEG) & (ecc > 0.15) & (
        _near_period(period, K.SIDEREAL_DAY_S / 2 / 60.0)
        | _near_period(period, K.SIDEREAL_DAY_S / 60.0))


def regime_ladder(apogee, perigee, ecc, incl, period) -> list[tuple[str, Column, Column]]:
    """(name, condition, reason) in ladder order; the last rule always holds."""
    geo = lit(K.GEO_ALTITUDE_KM)
    eccentric = (ecc >= K.HEO_ECC_MIN) & (apogee > 20000)
    transfer = (perigee < 2000) & (F.abs(apogee - geo) < 5000) & (incl < 30) & (
        ~at_critical_period(ecc, incl, period))
    fmt = F.format_string
    return [
        ("DECAYING", perigee < 150, fmt("perigee at %.0f km, strong drag", perigee)),
        ("GRAVEYARD", (perigee > geo + K.GRAVEYARD_MARGIN_KM) & (ecc < 0.05),
         fmt("%.0f km over the geostationary ring", perigee - geo)),
        ("GEO", (F.abs((apogee + perigee) / 2 - geo) < K.GEO_ALT_TOLERANCE_KM)
         & (ecc < K.GEO_ECC_MAX) & (incl < K.GEO_INCL_MAX_DEG),
         fmt("geostationary altitude at %.1f deg", incl)),
        ("GTO", eccentric & transfer,
         fmt("transfer ellipse %.0f x %.0f km", perigee, apogee)),
        ("HEO", eccentric, fmt("eccentricity %.2f with apogee %.0f km", ecc, apogee)),
        ("LEO", apogee < 2000, fmt("apogee at %.0f km", apogee)),
        ("MEO", (perigee >= 2000) & (apogee <= geo + K.GEO_ALT_TOLERANCE_KM),
         fmt("between %.0f and %.0f km", perigee, apogee)),
        ("OTHER", lit(True), fmt("unclassified %.0f x %.0f km, e=%.2f", perigee, apogee, ecc)),
    ]


def first_match(rules: list[tuple[Column, Column]]) -> Column:
    """CASE over (condition, value) pairs in order."""
    (cond, value), *rest = rules
    return reduce(lambda acc, rule: acc.when(*rule), rest, F.when(cond, value))


DISPOSAL_COMPLIANT = {
    "NOT_GEO_BELT": None,
    "COMPLIANT_GRAVEYARD": True,
    "OPERATIONAL_OR_ABANDONED_IN_PLACE": None,
    "INCLINED_GEOSYNCHRONOUS": None,
    "NON_COMPLIANT_SHALLOW": False,
    "BELOW_GEO_DRIFT": False,
}


def disposal_status(regime, apogee, perigee, ecc, incl, period) -> Column:
    mean_off = F.abs((apogee + perigee) / 2 - lit(K.GEO_ALTITUDE_KM))
    above = perigee - lit(K.GEO_ALTITUDE_KM)
    family = regime.isin("GEO", "GRAVEYARD") | ((mean_off < K.GEO_FAMILY_KM) & (ecc < 0.1))
    sync_min = K.SIDEREAL_DAY_S / 60.0
    synchronous = F.abs(period - lit(sync_min)) / lit(sync_min) < K.GEO_SYNC_TOLERANCE
    return (
        F.when(~family, "NOT_GEO_BELT")
        .when((perigee >= lit(K.GEO_ALTITUDE_KM + K.REORBIT_FLOOR_KM)) & (ecc < 0.05),
              "COMPLIANT_GRAVEYARD")
        .when((mean_off <= K.GEO_BOX_KM) & (incl <= K.GEO_INCL_MAX_DEG) & (ecc < K.GEO_ECC_MAX),
              "OPERATIONAL_OR_ABANDONED_IN_PLACE")
        .when(synchronous & (mean_off < K.NEAR_GEO_KM) & (incl > K.GEO_INCL_MAX_DEG),
              "INCLINED_GEOSYNCHRONOUS")
        .when((above > 0) & (above < K.REORBIT_FLOOR_KM), "NON_COMPLIANT_SHALLOW")
        .otherwise("BELOW_GEO_DRIFT")
    )


# ---------------------------------------------------------------- small rules
def burn_direction(dv_r, dv_i, dv_c) -> Column:
    total = F.abs(dv_r) + F.abs(dv_i) + F.abs(dv_c)
    return (
        F.when(total == 0, "mixed")
        .when(F.abs(dv_i) / total > 0.7, F.when(dv_i > 0, "prograde").otherwise("retrograde"))
        .when(F.abs(dv_c) / total > 0.7, "plane-change")
        .when(F.abs(dv_r) / total > 0.7, "radial")
        .otherwise("mixed")
    )


def threat_band(score) -> Column:
    return F.when(score >= 67, "high").when(score >= 34, "moderate").when(
        score.isNotNull(), "low")


def hard_body_radius_km(rcs_m2) -> Column:
    """Radius of a disc with the radar cross-section's area."""
    radius = F.sqrt(rcs_m2 / F.pi()) / 1000.0
    return F.when(rcs_m2.isNull() | (rcs_m2 <= 0), lit(K.DEFAULT_RADIUS_KM)).otherwise(
        F.greatest(radius, lit(K.MIN_RADIUS_KM)))


def modelled_sigma_km(age_days, axis: str) -> Column:
    """Modelled position sigma along one of the axes r, i, c."""
    start, growth = K.SIGMA_MODEL[axis]
    grown = F.when(age_days > 0, age_days).when(age_days.isNotNull(), 0.0)
    return lit(start) + lit(growth) * grown


def format_range(km) -> Column:
    return F.when(km < 1.0, F.format_string("%.0f m", km * 1000)).when(
        km.isNotNull(), F.format_string("%.1f km", km)).otherwise("n/a")


def plane_angle_deg(incl_a, raan_a, incl_b, raan_b) -> Column:
    """Angle between two orbital planes."""
    ia, ib = F.radians(incl_a), F.radians(incl_b)
    cosine = F.cos(ia) * F.cos(ib) + F.sin(ia) * F.sin(ib) * F.cos(F.radians(raan_a - raan_b))
    # least and greatest skip NULL, so an unknown angle needs its own branch
    return F.when(cosine.isNotNull(), F.degrees(F.acos(
        F.greatest(lit(-1.0), F.least(lit(1.0), cosine)))))


def days_between(later, earlier) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / lit(86400e6)

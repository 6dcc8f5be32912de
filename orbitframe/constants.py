"""Physical constants and published thresholds.

These must keep exactly these values for the results to be comparable.
"""

# --- physical constants (fixed values) ---
MU_KM3_S2 = 398600.4418
R_EARTH_KM = 6378.137
J2 = 1.08262668e-3
SIDEREAL_DAY_S = 86164.0905
GEO_ALTITUDE_KM = 35786.0
SUN_RATE_RAD_S = 1.99106e-7

# --- orbit classes (fixed values) ---
SSO_TOLERANCE_DEG = 1.5
CRITICAL_INCL_DEG = 63.4
CRITICAL_TOLERANCE_DEG = 2.5
PERIOD_TOLERANCE = 0.05
GEO_INCL_MAX_DEG = 15.0
GEO_ECC_MAX = 0.02
GEO_ALT_TOLERANCE_KM = 300.0
GRAVEYARD_MARGIN_KM = 150.0
HEO_ECC_MIN = 0.25
POLAR_MIN_DEG, POLAR_MAX_DEG = 80.0, 100.0
EQUATORIAL_MAX_DEG = 5.0

# --- disposal (fixed values) ---
REORBIT_FLOOR_KM = 235.0
GEO_BOX_KM = 100.0
GEO_SYNC_TOLERANCE = 0.03
NEAR_GEO_KM = 1500.0
GEO_FAMILY_KM = 2000.0

# --- manoeuvres and pattern of life (fixed values) ---
MIN_RESIDUALS = 6
MAX_GAP_DAYS = 10.0
Z_FLAG = 5.0
Z_STRONG = 12.0
MAD_TO_SIGMA = 1.4826
SIGMA_FLOOR = 1e-3
MIN_CAMPAIGNS = 3
Z_ANOMALOUS = 3.0
CAMPAIGN_GAP_DAYS = 1.0
RELATIVE_SIGMA = 0.15
MIN_SIDE = 3
T_THRESHOLD = 2.5
VARIANCE_FLOOR = 1e-12

# --- breakups (fixed values) ---
MIN_FRAGMENTS = 10
MIN_NEW_FRAGMENTS = 3
INCL_SPREAD_DEG = 5.0
MAX_ID_RELATIVE_MAD = 0.08
HIGH_FRAGMENTS = 100

# --- decay (fixed values) ---
REENTRY_KM = 100.0
MAX_DECAY_PERIGEE_KM = 2000.0
MIN_DECAY_POINTS = 6
MIN_DECAY_RATE = 0.02
ACCELERATION = 1.15
SCALE_HEIGHT_MIN_KM, SCALE_HEIGHT_MAX_KM = 20.0, 90.0

# --- screening and proximity (fixed values) ---
ALTITUDE_MARGIN_KM = 50.0
MAX_PLANE_ANGLE_DEG = 30.0
MIN_ALIGNED_SAMPLES = 20
CLOSE_RANGE_KM = 100.0
LOITER_SPEED_KMS = 0.05
LIKELY_DAYS = 3.0
MAX_EPOCH_GAP_DAYS = 3.0
PAIR_STEP_HOURS = 6.0
SIGMA_MODEL = {"r": (0.10, 0.02), "i": (0.20, 0.15), "c": (0.10, 0.01)}
DEFAULT_RADIUS_KM = 0.005
MIN_RADIUS_KM = 0.001
PC_SAMPLES = 200_000

# --- score (fixed values) ---
FACTOR_WEIGHTS = {
    "maneuver_activity": 0.20,
    "anomalous_rate": 0.30,
    "regime_sensitivity": 0.15,
    "proximity_to_hva": 0.25,
    "attribution": 0.10,
}
REGIME_WEIGHT = {
    "GEO": 1.0, "GRAVEYARD": 0.9, "MEO": 0.6, "LEO": 0.5,
    "HEO": 0.5, "GTO": 0.4, "DECAYING": 0.3, "OTHER": 0.3,
}
DEFAULT_REGIME_WEIGHT = 0.3
TAG_BUMP = {"MOLNIYA": 0.2, "TUNDRA": 0.2, "SSO": 0.15}
ACTIVITY_SATURATION_MS = 20.0
PROXIMITY_NEAR_KM, PROXIMITY_FAR_KM = 50.0, 5000.0
PROXIMITY_MAX_AGE_DAYS = 30.0
SAME_STRUCTURE_KM = 2.0

# --- text verification (fixed values) ---
NUMBER_PATTERN = r"-?\d+\.?\d*(?:[eE][-+]?\d+)?"
IDENTIFIER_PATTERN = r"\b[A-Za-z]+-?\d+[A-Za-z]*\b"
CLOCK_PATTERN = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
RELATIVE_TOLERANCE = 0.02
ABSOLUTE_TOLERANCE = 0.05

# --- watch (fixed values) ---
CLOSER_FRACTION = 0.5
IMMINENT_DAYS = 30.0

# --- listing sizes (fixed values) ---
PAGE_SIZE = 60
MAP_TARGET = 2200
FEATURED_MIN_SETS = 8
SPEC_DEFAULT_LIMIT, SPEC_MAX_LIMIT = 50, 200
# objects of each list that a first round of searches reads; each next round reads so many times more
SPEC_DEPTH, SPEC_DEEPER = 1024, 32
MIN_POPULATION = 20
FOREST_TREES, FOREST_SAMPLE = 200, 256

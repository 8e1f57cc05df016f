"""Fixed values that define the results; changing one changes the semantics."""

# Fix acceptance and step classification (metres, seconds, metres per second).
MAX_ACCURACY_M = 30.0
MAX_SPEED_MPS = 4.0
MIN_STEP_M = 1.0
MAX_CONFIRMED_STEP_M = 15.0
MAX_CONFIRMED_STEP_S = 6.0

# First centre of a map: what can be an accuracy, what is reliable, what is a gain.
STARTUP_POSSIBLE_ACCURACY_M = 100.0
STARTUP_LOCK_ACCURACY_M = 20.0
STARTUP_MAX_AGE_S = 30.0
STARTUP_MIN_GAIN_M = 10.0
STARTUP_MIN_GAIN_SHARE = 0.25

# Earth radii: great-circle distance and Web Mercator differ on purpose.
HAVERSINE_RADIUS_M = 6371000.0
MERCATOR_RADIUS_M = 6378137.0
METERS_PER_DEGREE = 111320.0
# Streets are matched in planar metres; the scale is that of the middle of a band of latitude.
LATITUDE_BAND = 0.5

# Exploration grid.
CELL_M = 15
CELL_AREA_M2 = 225
SAMPLE_M = 3.75
CAPTURE_RADIUS_M = 15 / 2**0.5

# Enclosure detection.
MAX_LOOP_AREA_M2 = 150_000
MAX_LOOP_CELLS = MAX_LOOP_AREA_M2 // CELL_AREA_M2
MIN_LOOP_M = 80.0
MIN_LOOP_POINTS = 4

# Street coverage.
STREET_MATCH_M = 12.0
STREET_MATCH_DEGREES = 50.0
STREET_SAMPLE_M = 3.0
STREET_BIN_M = 4.0
STREET_BUCKET_M = 20.0
STREET_MIN_STEP_M = 1.5
STREET_DONE_SHARE = 0.9

# Gap routing.
SNAP_M = 30.0
SNAP_BAND_M = 4.0
SNAP_LIMIT = 6
CONNECTOR_M = 12.0
JOIN_MIN_M = 0.15
JOIN_MAX_M = 8.0
CROSSING_BUCKET_M = 32.0
DETOUR_FACTOR = 2.25
DETOUR_EXTRA_M = 250.0
HIGH_FACTOR = 1.35
HIGH_EXTRA_M = 60.0

# Zones.
BOUNDARY_FRESH_DAYS = 30

# Live routes, previews, archives, late data.
CHUNK_VERTICES = 256
LIVE_TAIL = 300
PREVIEW_LIMIT = 2500
HOT_RECORDINGS = 20
BLOCK_RECORDINGS = 20
BLOCK_POINTS = 25_000
GRACE_SECONDS = 300
REORDER_MS = 750

# Street classes.
NOT_WALKABLE_HIGHWAYS = ["motorway", "motorway_link", "trunk", "trunk_link"]
LOOP_HIGHWAYS = [
    "footway", "living_street", "path", "pedestrian", "residential", "service", "steps",
]
FOOT_YES = ["designated", "permissive", "yes"]

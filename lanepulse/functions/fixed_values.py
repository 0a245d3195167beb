"""Names, thresholds and bin edges every report must agree on.

They are domain constants, stated in natural order and used by name elsewhere.
"""

# --- fixed values: rush windows, in hours of the day ------------------------
MORNING = (6, 10)
EVENING = (17, 21)

# --- fixed values: plausible ranges of a reading ----------------------------
SPEED_RANGE = (0, 200)
OCCUPANCY_RANGE = (0, 100)
VOLUME_MIN = 0

# --- fixed values: congestion severity --------------------------------------
SEVERE = {"occupancy_above": 50, "speed_below": 40}
MODERATE = {"occupancy_above": 30, "speed_below": 60}

# --- fixed values: flow regimes ---------------------------------------------
FREE_FLOW = "Free Flow"
SYNCHRONIZED = "Synchronized Flow"
WIDE_JAM = "Wide Moving Jam"
CONGESTED = "Congested Flow"
TRANSITIONAL = "Transitional"
FREE_SPEED_ABOVE, FREE_OCCUPANCY_BELOW = 60, 20
SYNC_SPEED, SYNC_OCCUPANCY = (30, 60), (20, 40)
JAM_SPEED_BELOW, JAM_OCCUPANCY_ABOVE = 30, 40

# --- fixed values: calendar names -------------------------------------------
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
SEASONS = (("Spring", (3, 4, 5)), ("Summer", (6, 7, 8)), ("Autumn", (9, 10, 11)), ("Winter", (12, 1, 2)))

# --- fixed values: district spelling ----------------------------------------
DISTRICT_SPELLING = {"Central & Western": "Central and Western"}

# --- fixed values: bins as (label, comparison, bound); the last one is open --
VOLUME_BINS = (
    ("0-Empty", "==", 0),
    ("1-5", "<=", 5),
    ("6-10", "<=", 10),
    ("11-20", "<=", 20),
    ("21-30", "<=", 30),
    ("31-40", "<=", 40),
    ("41-50", "<=", 50),
    ("51-75", "<=", 75),
    ("76-100", "<=", 100),
    ("100+", None, None),
)
OCCUPANCY_BINS = (
    ("0-10%", "<", 10),
    ("10-20%", "<", 20),
    ("20-30%", "<", 30),
    ("30-40%", "<", 40),
    ("40-50%", "<", 50),
    ("50-60%", "<", 60),
    ("60-70%", "<", 70),
    ("70-80%", "<", 80),
    ("80%+", None, None),
)
FINE_OCCUPANCY_BINS = (
    ("0-5%", "<", 5),
    ("5-10%", "<", 10),
    ("10-15%", "<", 15),
    ("15-20%", "<", 20),
    ("20-25%", "<", 25),
    ("25-30%", "<", 30),
    ("30-35%", "<", 35),
    ("35-40%", "<", 40),
    ("40-45%", "<", 45),
    ("45-50%", "<", 50),
    ("50-60%", "<", 60),
    ("60-70%", "<", 70),
    ("70-80%", "<", 80),
    ("80%+", None, None),
)
FLOW_BINS = (
    ("Low (0-10)", "<=", 10),
    ("Medium (11-30)", "<=", 30),
    ("High (31-50)", "<=", 50),
    ("Very High (50+)", None, None),
)
DENSITY_BINS = (
    ("Low (<20%)", "<", 20),
    ("Medium (20-40%)", "<", 40),
    ("High (40-60%)", "<", 60),
    ("Very High (60%+)", None, None),
)

# --- fixed values: text patterns of the reading files -----------------------
DATE_PATTERN = r"(\d{4}-\d{2}-\d{2})"
TIME_PATTERN = r"(\d{2}:\d{2}:\d{2})"
FILE_DATE_PATTERN = r"(\d{4})(\d{2})(\d{2})-"

# --- fixed values: phases of the timing table --------------------------------
TOTAL_PHASE = "Total Execution"
FAILED_MARK = "FAILED"

# --- fixed values: report sizes and limits -----------------------------------
MIN_OBSERVATIONS = 100
HIGH_OCCUPANCY_PCT = 50
BYTES_PER_CSV_ROW = 200

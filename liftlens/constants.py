"""Fixed values.

These must equal the values the analysed dashboard uses, otherwise the
reports differ: the targeting-map key that carries the user id, the column
names of the delivery logs that identify one ad serve, the band labels and
decile edges, the report column names and the verdict sentences.
"""

# --- fixed values -----------------------------------------------------------

# Key of the CustomTargeting map whose value is the user id.
USER_ID_KEY = "vnd_4d_xid"

# Columns that identify one ad serve in both delivery logs; a click belongs to
# an impression when all of them and the user id are equal.
SERVE_KEYS = (
    "Time",
    "AdvertiserId",
    "OrderId",
    "LineItemId",
    "CreativeId",
    "CreativeVersion",
    "CreativeSize",
    "AdUnitId",
    "CityId",
    "TimeUsec",
    "Product",
)

# Decile bands: deciles 1-3 high, 4-7 medium, 8-10 low, anything else unscored.
BAND_HIGH = "1. H"
BAND_MEDIUM = "2. M"
BAND_LOW = "3. L"
BAND_UNSCORED = "Unscored"
HIGH_MAX_DECILE = 3
MEDIUM_MIN_DECILE = 4
MEDIUM_MAX_DECILE = 7
LOW_MIN_DECILE = 8
BANDS = (BAND_HIGH, BAND_MEDIUM, BAND_LOW)
DECILES = tuple(range(1, 11))

# Report column names.
ORDER_NAME_COLUMN = "Orders_Analyzed"
CTR_PERCENT_COLUMN = "ctr %"

# Significance test.
DEFAULT_ALPHA = 0.05
VERDICT_REJECTED = (
    "The p_value is less than alpha. The null hypothesis is rejected, "
    "and the models are significantly different."
)
VERDICT_NOT_REJECTED = (
    "The p_value is greater than or equal to alpha. The null hypothesis is NOT "
    "rejected, and the models are NOT significantly different."
)

# Section title prefix per model, e.g. "Model 1: <segment name>".
MODEL_TITLE_PREFIX = "Model "

# Sentences in front of a test's values and of the score correlation.
P_VALUE_TEXT = "The calculated p_value is: "
ALPHA_TEXT = "alpha is: "
CORRELATION_TEXT = "The correlation between the scores of the two models is: "

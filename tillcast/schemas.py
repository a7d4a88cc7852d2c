"""Fixed schemas of the three retail inputs and of the feature table.

Inputs are read with these schemas; nothing is inferred, so a 100 TB read
does not pay an inference pass and types never drift between files.
"""

from pyspark.sql import types as T

ORDERS = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("itemID", T.LongType()),
    T.StructField("order", T.IntegerType()),
    T.StructField("salesPrice", T.DoubleType()),
])

ITEMS = T.StructType([
    T.StructField("itemID", T.LongType()),
    T.StructField("brand", T.StringType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("customerRating", T.DoubleType()),
    T.StructField("category1", T.StringType()),
    T.StructField("category2", T.StringType()),
    T.StructField("category3", T.StringType()),
    T.StructField("recommendedRetailPrice", T.DoubleType()),
])

INFOS = T.StructType([
    T.StructField("itemID", T.LongType()),
    T.StructField("simulationPrice", T.DoubleType()),
    T.StructField("promotion", T.StringType()),
])

ITEM_COLUMNS = ["brand", "manufacturer", "customerRating", "category1", "category2",
                "category3", "recommendedRetailPrice"]

# Fixed values of the feature table: lag offsets (days), number of Fourier
# components, and the rolling window (previous days).
LAGS = (1, 2, 3, 7)
N_HARMONICS = 5
ROLLING_DAYS = 7

# Column order of the feature table (train.csv / test.csv), without `split`.
FEATURE_COLUMNS = (
    ["date", "itemID", "qty_sold"]
    + [f"qty_sold_lag{k}" for k in LAGS]
    + ["promotion", "maxItemPrice", "minItemPrice", "Price", "PriceToday", "medianDiscPerc"]
    + ITEM_COLUMNS
    + ["weekDay", "day", "weekOfMonth"]
    + [f"harmonic_{i}" for i in range(N_HARMONICS)]
    + ["cum_sum_order", "rolling_qty_sold_mean", "rolling_qty_sold_std",
       "rolling_qty_sold_median"]
    + [f"PricePerEach_lag{k}" for k in LAGS]
    + [f"sales_value_lag{k}" for k in LAGS]
    + ["random_noise1", "random_noise2"]
)

# Model inputs (40 features) and target.
MODEL_FEATURES = (
    ["itemID"] + [f"qty_sold_lag{k}" for k in LAGS]
    + ["promotion", "maxItemPrice", "minItemPrice", "Price", "PriceToday", "medianDiscPerc"]
    + ["brand", "manufacturer", "customerRating", "category1", "category2", "category3",
       "recommendedRetailPrice", "weekDay", "day", "weekOfMonth"]
    + [f"harmonic_{i}" for i in range(N_HARMONICS)]
    + ["cum_sum_order", "rolling_qty_sold_mean", "rolling_qty_sold_std",
       "rolling_qty_sold_median"]
    + [f"PricePerEach_lag{k}" for k in LAGS]
    + [f"sales_value_lag{k}" for k in LAGS]
    + ["random_noise1", "random_noise2"]
)
CATEGORICAL_FEATURES = ["promotion", "brand", "manufacturer", "category1", "category2",
                        "category3"]
TARGET = "qty_sold"

"""Names, constants and parameter settings of the credit workload.

They have to equal the published ones for results to agree, so they are written
out here as they are.
"""

# Fixed value: day offset that stands for "not employed".
EMPLOYMENT_SENTINEL = 365243

# Columns summarised together.
DESCRIBE_COLUMNS = [
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "YEARS_OLD",
    "CREDIT_DURATION",
]

# Key, collinear and mistyped columns left out of the models.
DROP_COLUMNS = [
    "SK_ID_CURR",
    "DAYS_REGISTRATION",
    "EXT_SOURCE_2",
    "AMT_GOODS_PRICE",
    "AMT_ANNUITY",
]

# The seven dimensions of the paid and default rates.
OUTCOME_DIMENSIONS = [
    "CODE_GENDER",
    "OCCUPATION_TYPE",
    "FLAG_OWN_REALTY",
    "NAME_FAMILY_STATUS",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "REGION_RATING_CLIENT",
]

# Decision thresholds and class share.
LOGISTIC_THRESHOLD = 0.617701
BOOSTED_THRESHOLD = 0.7327
ZERO_SHARE = 0.9193422410666964

# Bins of the years-of-work and income histograms.
WORK_BINS = 50
INCOME_BINS = 4000

# Features kept after voting, principal components.
VOTED_FEATURES = 25
COMPONENTS = 7

# Parameter settings of the models.
LOGISTIC_QUICK = {"maxIter": 5, "threshold": LOGISTIC_THRESHOLD}
LOGISTIC_TUNED = {
    "maxIter": 200,
    "aggregationDepth": 10,
    "threshold": LOGISTIC_THRESHOLD,
    "elasticNetParam": 0.8,
    "fitIntercept": False,
}
FOREST_TUNED = {
    "numTrees": 200,
    "maxBins": 20,
    "maxDepth": 10,
    "impurity": "gini",
    "subsamplingRate": 0.4,
}
BOOSTED_TUNED = {
    "learning_rate": 0.075,
    "max_depth": 4,
    "subsample": 0.7,
    "colsample_bytree": 0.7,
    "min_child_weight": 1,
    "gamma": 1,
    "scale_pos_weight": 92,
    "num_round": 10,
    "seed": 0,
}
# The published settings that Spark's own boosted trees have no counterpart for.
BOOSTED_PUBLISHED = BOOSTED_TUNED | {
    "num_parallel_tree": 10,
    "grow_policy": "lossguide",
    "alpha": 1,
    "lambda_": 1,
}

# Search grids.
LOGISTIC_GRID = {
    "aggregationDepth": [2, 7, 15],
    "elasticNetParam": [0.0, 0.4, 1.0],
    "fitIntercept": [False, True],
    "maxIter": [10, 100, 500],
    "regParam": [0.01, 0.5, 2.0],
    "threshold": [0.5, 0.617701, 0.92],
}
FOREST_GRID = {
    "maxDepth": [2, 4, 6, 10],
    "maxBins": [20, 60, 100],
    "numTrees": [5, 20, 100],
    "impurity": ["gini", "entropy"],
    "subsamplingRate": [0.2, 0.4, 0.7],
}
BOOSTED_GRID = {
    "scale_pos_weight": [1, 75, 92],
    "max_depth": [5, 15, 50, 80],
    "subsample": [0.6, 0.8, 0.9],
    "n_estimators": [10, 100, 500],
    "colsample_bytree": [0.2, 0.3, 0.4],
    "grow_policy": ["depthwise", "lossguide"],
    "gamma": [0, 1, 5],
    "lamda": [0, 1, 5],
    "alpha": [0, 1, 5],
}

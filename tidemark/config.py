"""Parameters of the engine. Values that results depend on are fixed by the published behaviour."""

EVENT_WEIGHTS = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}
SESSION_GAP_MINUTES = 30
TOP_K = 10
MIN_INTERACTIONS = 3.0
SVD_FACTORS = 50
SEED = 42
HALF_LIFE_DAYS = 14.0
OUTLIER_PERCENTILE = 0.99
TFIDF_MAX_FEATURES = 5000
PRICE_BUCKETS = 5
TEST_FRACTION = 0.2
MIN_TRAIN_INTERACTIONS = 2
EVAL_K = 10
CF_NEIGHBOURS = 20
CF_EXTRA = 5
EVAL_PAD = 20
HYBRID_WEIGHTS = {"cf": 0.6, "content": 0.25, "popularity": 0.15}
HYBRID_OVERFETCH = 3
CF_METHODS = ("item_based", "user_based", "svd")
EXPLAIN_CONFIDENCE = 0.3

"""Fixed values that must equal the reference application's for equal results.

Everything here is data, stated plainly and in the reference's order.
"""

# --- fixed values: segment rule (RFM_Score lower bounds, checked top-down) ---
SEGMENT_RULES = [
    (10, "Champions"),
    (8, "Loyal Customers"),
    (6, "Potential Loyalists"),
    (4, "At Risk"),
]
SEGMENT_ELSE = "Lost"
SEGMENTS = ["Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Lost"]

# --- fixed values: recommendation text per segment ---
RECOMMENDATIONS = {
    "Champions": "Reward with VIP loyalty program & early product access.",
    "Loyal Customers": "Offer upsell bundles and premium membership.",
    "Potential Loyalists": "Send personalized offers and membership invites.",
    "At Risk": "Launch win-back campaign with 20% exclusive discount.",
    "Lost": "Final re-engagement email or remove from active list.",
}

# --- fixed values: churn-risk rule on Recency in days (High > 90, Medium > 45) ---
CHURN_HIGH_DAYS = 90
CHURN_MEDIUM_DAYS = 45
RISK_LEVELS = ["Low", "Medium", "High"]

# --- fixed values: risk from a model probability (High > 0.6, Medium > 0.3) ---
PROB_HIGH = 0.6
PROB_MEDIUM = 0.3

# --- fixed values: scoring-request defaults and derived inputs ---
DEFAULT_RECENCY = 30.0
DEFAULT_FREQUENCY = 5.0
DEFAULT_MONETARY = 500.0
ITEMS_PER_ORDER = 15
PRODUCTS_PER_ORDER = 8
MAX_UNIQUE_PRODUCTS = 200

# --- fixed values: cluster labels ---
CLUSTER_LABELS = ["VIP", "High Value", "Active Mid", "Dormant Low"]

# --- fixed values: training set-up ---
SEED = 42
CV_FOLDS = 5
TEST_FRACTION = 0.2
OVERFIT_GAP_PP = 8.0
SMOTE_LOW, SMOTE_HIGH = 0.4, 0.6
SMOTE_K = 5

NUMERIC_FEATURES = ["Recency", "Frequency", "Monetary", "AvgOrderValue",
                    "TotalItems", "UniqueProducts", "Cluster"]
CATEGORICAL_FEATURES = ["Country"]
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
LEAKY_COLUMNS = ["ChurnScore", "R_Score", "F_Score", "M_Score", "RFM_Score",
                 "CLV", "Segment", "Recommendation", "ClusterLabel",
                 "ChurnRisk", "ChurnBinary", "CustomerID"]
LEAKY_REPORTED = LEAKY_COLUMNS[:9]

# --- fixed values: probabilistic churn label (min-max features, log-odds weights) ---
LABEL_FEATURES = ["Recency", "Frequency", "Monetary", "AvgOrderValue", "UniqueProducts"]
LABEL_WEIGHTS = {"Recency": 3.5, "Frequency": -2.0, "Monetary": -1.0,
                 "UniqueProducts": -0.5, "AvgOrderValue": -0.3}
LABEL_INTERCEPT = -2.0
LABEL_NOISE_STD = 1.2
ONEHOT_MIN_FREQUENCY = 0.01
RARE_BUCKET = "Country_infrequent_sklearn"

# --- fixed values: model names and hyper-parameters ---
MODEL_NAMES = ["Logistic Regression", "Decision Tree", "Random Forest",
               "XGBoost", "KNN", "Gradient Boosting"]
IMPORTANCE_ORDER = ["Random Forest", "XGBoost", "Gradient Boosting", "Decision Tree"]

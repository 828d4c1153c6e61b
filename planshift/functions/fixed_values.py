"""Values that have to be exactly these for results to agree with existing models and tables.

Nothing here is logic.  Every job takes these as defaults and accepts others, so the
engine also runs on tables with other names and codes.
"""

# --- fixed values: tier names and their order ------------------------------------------
TIER_RANKS = {
    "BASIC VIDEO": 10,
    "DIGITAL ECONOMY VIDEO": 20,
    "DIGITAL STARTER VIDEO": 30,
    "DIGITAL PREFERRED VIDEO": 40,
}

# --- fixed values: label and category codes --------------------------------------------
POSITIVE_TIER = "DIGITAL PREFERRED VIDEO"
RARE_TIER = "DIGITAL ECONOMY VIDEO"
TIER_CLASS_CODES = {
    "DIGITAL PREFERRED VIDEO": 1,
    "DIGITAL STARTER VIDEO": 2,
    "DIGITAL ECONOMY VIDEO": 3,
}
PRIOR_TIER_CODES = {"DIGITAL STARTER VIDEO": 1, "DIGITAL ECONOMY VIDEO": 2}
PRIOR_TIER_DEFAULT = 3
PRODUCT_MIX_CODES = {
    "VIDEO ONLY": 1,
    "VIDEO/HSD": 2,
    "VIDEO/HSD/CDV": 3,
    "VIDEO/HSD/XH": 4,
    "VIDEO/HSD/CDV/XH": 5,
}
PRODUCT_MIX_DEFAULT = 0

# --- fixed values: cell cleaning --------------------------------------------------------
CELL_SENTINELS = {"None": 0, "Y": 1, "N": 0, " ": 0}
TENURE_CAP_AT = 74
TENURE_CAP_TO = 75
MISSING_NUMERIC = 99999
MISSING_TEXT = "NA"

# --- fixed values: numeric constants ----------------------------------------------------
WOE_SMOOTHING = 0.001
VIF_LIMIT = 10.0
POSITIVE_CLASS_WEIGHT = 0.647322
TEST_SHARE = 0.20
SPLIT_SEED = 3
CORRELATION_FLOOR = 0.015

# --- fixed values: sale filters ---------------------------------------------------------
ACTIVE_STATUSES = ("ACT",)
CHANNEL_CONTAINS = "Dot"
TASK_PREFIX = "Tier Change - Upgrade"
SUB_TASK = "VideoU"

# --- fixed values: model settings -------------------------------------------------------
IMPORTANCE_FOREST = {"numTrees": 200, "maxDepth": 4, "featureSubsetStrategy": "sqrt"}
BALANCED_FOREST = {"numTrees": 200, "maxDepth": 3, "featureSubsetStrategy": "sqrt", "seed": 1}
BOOSTED_TREES = {"maxIter": 400, "maxDepth": 3, "stepSize": 0.02}
BOOSTED_TREES_DEEP = {
    "maxIter": 1000, "maxDepth": 3, "stepSize": 0.03, "minInstancesPerNode": 2, "seed": 87,
}
LOGISTIC_C = 1.0
NEURAL_HIDDEN = (100, 100)
NEURAL_MAX_ITER = 1000
NEURAL_PENALTY = 0.1
NEURAL_BATCH = 200
GENETIC = {
    "max_features": 5, "population": 50, "generations": 40, "folds": 3, "crossover": 0.5,
    "mutation": 0.2, "swap_each": 0.5, "flip_each": 0.05, "tournament": 3, "patience": 10,
}

# --- fixed values: named feature sets ---------------------------------------------------
REDUCED_12 = """
    prev_video_tier_name_enc productmix tenure_by_account dcom_total_num_of_pages_l7d
    dcom_total_timespent_seconds_l7d dcom_total_num_of_visits_l7d
    dcom_total_num_of_product_views_l7d product_view_flag dealsofferspage_flag
    add_to_cart_flag dcom_total_add_to_cart_items_l7d dcom_web_dayssince_last_visit
""".split()

BROAD_24 = """
    prev_video_tier_name_enc productmix dcom_total_num_of_pages_l7d
    dcom_total_num_of_visits_l7d dcom_total_add_to_cart_items_l7d tenure_by_account
    dcom_total_num_of_purchases_l7d dcom_total_timespent_seconds_l7d
    dcom_total_num_of_product_views_l7d dcom_web_dayssince_last_visit purchase_flag
    product_view_flag add_to_cart_flag payment_flag search_flag campaign_flag
    dealsofferspage_flag learntvpage_flag learninternetpage_flag learnvoicepage_flag
    learnxfinitymobilepage_flag comparecompetitorpage_flag dealsinareapage_flag
    learnbundlespage_flag
""".split()

GENETIC_36 = """
    dcom_web_num_of_visits_l7d dcom_web_num_of_product_views_7d
    dcom_web_num_of_payments_15d dcom_web_move_likely_specialist_l3d dcom_web_bill_pay
    dcom_web_downgrade_order dcom_web_call_me_back dcom_web_localization
    dcom_web_uid_personal_email_verified dcom_web_uid_account_lookup_complete
    dcom_mobile_timespent_seconds_l7d dcom_mobile_num_of_product_views_7d
    dcom_mobile_num_of_payments_15d dcom_mobile_move_likely_l7d
    dcom_mobile_move_likely_specialist_l3d dcom_mobile_buyflow_starts
    dcom_mobile_sik_eligible dcom_mobile_bill_pay dcom_mobile_itg_completes
    dcom_mobile_uid_password_reset_complete dcom_mobile_localization_decision
    dcom_total_num_of_payments_l7d dcom_total_move_likely_specialist_l3d
    dcom_total_move_likely_specialist_l7d dcom_total_move_internal_search_l3d
    dcom_total_buyflow_customer_order_review_step dcom_total_scheduled_single_pay
    dcom_total_itg_completes dcom_total_uid_username_password_creation learntvpage_flag
    careerspage_flag watchtvonlinepage_flag downloadnortonintsecpage_flag
    manageaccountpage_flag upgradeservicepage_flag prev_video_tier_name_enc
""".split()

GENETIC_42 = GENETIC_36[:-1] + """
    search_flag_m campaign_flag_m comparecompetitorpage_flag_m careerspage_flag_m
    servicecenterlocationspage_flag_m contactuspage_flag_m prev_video_tier_name_enc
""".split()

FEATURE_SETS = {
    "reduced_12": REDUCED_12,
    "broad_24": BROAD_24,
    "genetic_36": GENETIC_36,
    "genetic_42": GENETIC_42,
}

# --- fixed values: columns kept out of modelling ----------------------------------------
EXCLUDED_COLUMNS = """
    utc_accountid utc_account utc_day_id utc_yearmonth days_since_last_visit utc_video_tier_name
    customer_account_id geo_city geo_region day_id current_mrc visit_day_id_dailytable
    dcom_web_visit_division dcom_web_visit_region dcom_mobile_visit_region dcom_mobile_visit_division
    dcom_visit_region itg_topic dcom_visit_divison amount_paid prev_video_tier_name product_mix
    dcom_web_num_of_visits_l15d dcom_web_num_of_visits_l60d dcom_web_num_of_visits_l90d
    dcom_web_num_of_visits_l180d dcom_web_num_of_pages_l15d dcom_web_num_of_pages_l60d
    dcom_web_num_of_pages_l90d dcom_web_num_of_pages_l180d dcom_web_timespent_seconds_l15d
    dcom_web_timespent_seconds_l60d dcom_web_timespent_seconds_l90d dcom_web_timespent_seconds_l180d
    dcom_web_num_of_purchases_l15d dcom_web_num_of_purchases_l60d dcom_web_num_of_purchases_l90d
    dcom_web_num_of_purchases_l180d dcom_web_num_of_product_views_60d dcom_web_num_of_product_views_90d
    dcom_web_num_of_product_views_180d dcom_web_add_to_cart_items_60d dcom_web_add_to_cart_items_90d
    dcom_web_add_to_cart_items_180d dcom_web_num_of_payments_60d dcom_web_num_of_payments_90d
    dcom_web_num_of_payments_180d dcom_web_move_order_l90d dcom_web_move_order_l180d
    dcom_web_move_likely_l14d dcom_web_move_likely_localize_l14d dcom_web_move_likely_install_l14d
    dcom_web_move_likely_specialist dcom_web_move_likely_specialist_l14d dcom_web_move_likely_contactus_l14d
    dcom_web_move_internal_search_l14d dcom_mobile_num_of_visits dcom_mobile_num_of_visits_l15d
    dcom_mobile_num_of_visits_l60d dcom_mobile_num_of_visits_l90d dcom_mobile_num_of_visits_l180d
    dcom_mobile_num_of_pages dcom_mobile_num_of_pages_l15d dcom_mobile_num_of_pages_l60d
    dcom_mobile_num_of_pages_l90d dcom_mobile_num_of_pages_l180d dcom_mobile_timespent_seconds
    dcom_mobile_timespent_seconds_l15d dcom_mobile_timespent_seconds_l60d dcom_mobile_timespent_seconds_l90d
    dcom_mobile_timespent_seconds_l180d dcom_mobile_num_of_purchases dcom_mobile_num_of_purchases_l15d
    dcom_mobile_num_of_purchases_l60d dcom_mobile_num_of_purchases_l90d dcom_mobile_num_of_purchases_l180d
    dcom_mobile_num_of_product_views dcom_mobile_num_of_product_views_15d
    dcom_mobile_num_of_product_views_60d dcom_mobile_num_of_product_views_90d
    dcom_mobile_num_of_product_views_180d dcom_mobile_add_to_cart_items dcom_mobile_add_to_cart_items_15d
    dcom_mobile_add_to_cart_items_60d dcom_mobile_add_to_cart_items_90d dcom_mobile_add_to_cart_items_180d
    dcom_mobile_num_of_payments dcom_mobile_num_of_payments_60d dcom_mobile_num_of_payments_90d
    dcom_mobile_num_of_payments_180d dcom_mobile_move_order dcom_mobile_move_order_l90d
    dcom_mobile_move_order_l180d dcom_mobile_move_likely dcom_mobile_move_likely_l14d
    dcom_mobile_move_likely_localize dcom_mobile_move_likely_localize_l14d dcom_mobile_move_likely_install
    dcom_mobile_move_likely_install_l14d dcom_mobile_move_likely_specialist
    dcom_mobile_move_likely_specialist_l14d dcom_mobile_move_likely_contactus
    dcom_mobile_move_likely_contactus_l14d dcom_mobile_move_internal_search
    dcom_mobile_move_internal_search_l14d dcom_total_num_of_visits dcom_total_num_of_visits_l15d
    dcom_total_num_of_visits_l60d dcom_total_num_of_visits_l90d dcom_total_num_of_visits_l180d
    dcom_total_num_of_pages dcom_total_num_of_pages_l15d dcom_total_num_of_pages_l60d
    dcom_total_num_of_pages_l90d dcom_total_num_of_pages_l180d dcom_total_timespent_seconds
    dcom_total_timespent_seconds_l15d dcom_total_timespent_seconds_l60d dcom_total_timespent_seconds_l90d
    dcom_total_timespent_seconds_l180d dcom_total_num_of_purchases dcom_total_num_of_purchases_l15d
    dcom_total_num_of_purchases_l60d dcom_total_num_of_purchases_l90d dcom_total_num_of_purchases_l180d
    dcom_total_num_of_product_views dcom_total_num_of_product_views_l15d
    dcom_total_num_of_product_views_l60d dcom_total_num_of_product_views_l90d
    dcom_total_num_of_product_views_l180d dcom_total_add_to_cart_items dcom_total_add_to_cart_items_l15d
    dcom_total_add_to_cart_items_l60d dcom_total_add_to_cart_items_l90d dcom_total_add_to_cart_items_l180d
    dcom_total_num_of_payments dcom_total_num_of_payments_l15d dcom_total_num_of_payments_l60d
    dcom_total_num_of_payments_l90d dcom_total_num_of_payments_l180d dcom_dayssince_last_visit
    dcom_total_move_order dcom_total_move_order_l90d dcom_total_move_order_l180d dcom_total_move_likely
    dcom_total_move_likely_l14d dcom_total_move_likely_localize dcom_total_move_likely_localize_l14d
    dcom_total_move_likely_install dcom_total_move_likely_install_l14d dcom_total_move_likely_specialist
    dcom_total_move_likely_specialist_l14d dcom_total_move_likely_contactus
    dcom_total_move_likely_contactus_l14d dcom_total_move_internal_search
    dcom_total_move_internal_search_l14d
""".split()

"""Oracle SQL for feature views, predictions and client analytics."""

from __future__ import annotations

import itertools

from carelake.config import TESTDATA as P
from carelake.functions.stats import AS_B, AS_P, INV_SQRT_2PI
from carelake.operators.pivot import WEEKDAYS
from carelake.plans.features import LEAKAGE_DIMS, READMISSION_DIMS
from oracle.sql import Q as DASH


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# the provider specialties of the test hospital
SPECIALTIES = ["Cardiology", "Orthopedics", "Oncology", "Neurology", "General Surgery", "Internal Medicine", "Pulmonology",
               "Gastroenterology"]
Z = dbl(1.96)
RUN_TS = f"TIMESTAMP '{P.as_of} 00:00:00'"


def cdf(z: str) -> str:
    a = f"abs({z})"
    t = f"({dbl(1.0)} / ({dbl(1.0)} + {dbl(AS_P)} * {a}))"
    b = [dbl(x) for x in AS_B]
    poly = f"({t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]})))))"
    upper = f"({dbl(INV_SQRT_2PI)} * exp(-({a} * {a}) / 2) * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN {dbl(1.0)} - {upper} ELSE {upper} END)"


def days(lo: str, hi: str) -> str:
    return (f"SELECT CAST(unnest(generate_series(CAST({lo} AS TIMESTAMP), CAST({hi} AS TIMESTAMP), "
            f"INTERVAL 1 DAY)) AS DATE) AS D")


# the terms of a day between LO and HI: level, trend, Monday to Saturday, two waves of a year
N_TERMS = 12


def terms(d: str) -> str:
    span = "CAST(greatest(date_diff('day', LO, HI), 1) AS DOUBLE)"
    on = f"(CASE WHEN {span} >= 730 THEN 1.0 ELSE 0.0 END)"
    turn = f"(date_diff('day', DATE '1970-01-01', {d}) * {dbl(6.283185307179586 / 365.25)})"
    marks = [f"CASE WHEN dayofweek({d}) = {k} THEN 1.0 ELSE 0.0 END" for k in range(1, 7)]
    waves = [f"{on} * {f}({turn} * {k})" for k in (1, 2) for f in ("sin", "cos")]
    return "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in ["1", f"date_diff('day', LO, {d}) / {span}", *marks, *waves]) + "]"


def lin(b: str, x: str) -> str:
    return f"list_dot_product({b}, {x})"


def quad(c: str, x: str) -> str:
    return f"list_dot_product({x}, list_transform({c}, lambda row: list_dot_product(row, {x})))"


def least_squares(prefix: str, src: str) -> dict[str, str]:
    """{prefix}_model: SERIES, N, B, C (inverse), by Gauss-Jordan elimination in a recursive query."""
    ij = range(1, N_TERMS + 1)
    row = lambda i: ", ".join([f"sum(X[{i}] * X[{j}])" + (" + 1e-6" if i == j > 1 else "") for j in ij]
                              + [f"sum(X[{i}] * Y)"] + [str(float(i == j)) for j in ij])
    return {
        f"{prefix}_sums": f"SELECT SERIES, count(*) AS N, CAST([{', '.join(f'[{row(i)}]' for i in ij)}] AS DOUBLE[][]) AS M FROM {src} GROUP BY 1",
        f"{prefix}_model": f"""SELECT SERIES, N, list_transform(M, lambda r: r[{N_TERMS + 1}]) AS B,
                    list_transform(M, lambda r: r[{N_TERMS + 2}:]) AS C
             FROM (WITH RECURSIVE g AS (
                     SELECT SERIES, N, 1 AS K, M FROM {prefix}_sums
                     UNION ALL
                     SELECT SERIES, N, K + 1, list_transform(M, lambda r, i: list_transform(r, lambda v, j:
                       CASE WHEN i = K THEN v / M[K][K] ELSE v - M[i][K] * M[K][j] / M[K][K] END))
                     FROM g WHERE K <= {N_TERMS})
                   SELECT * FROM g WHERE K = {N_TERMS + 1})""",
    }


def _drivers(prefix: str, src: str, metric: str, dims: list[str]) -> dict[str, str]:
    # every segment of up to three dimensions, counted from the rows; then support and redundancy
    subsets = [c for k in range(4) for c in itertools.combinations(range(len(dims)), k)]
    value = [f"coalesce(CAST({d} AS VARCHAR), 'NULL')" for d in dims]
    segs = [f"{{'S': CAST([{', '.join(map(str, c))}] AS INTEGER[]), 'W': CAST([{', '.join(value[i] for i in c)}] AS VARCHAR[])}}" for c in subsets]
    names = "[" + ", ".join(f"'{d}'" for d in dims) + "]"

    rt = "CASE WHEN TEST_COUNT > 0 THEN S_T / TEST_COUNT END"
    rc = "CASE WHEN CONTROL_COUNT > 0 THEN S_C / CONTROL_COUNT END"
    contrib = "CASE WHEN NT > 0 AND NC > 0 THEN S_T / NT - S_C / NC END"
    change = "abs(CASE WHEN NT > 0 THEN ST / NT END - CASE WHEN NC > 0 THEN SC / NC END)"
    return {
        f"{prefix}_x": f"SELECT {metric} AS M, LABEL AS L, unnest([{', '.join(segs)}]) AS S FROM {src}",
        f"{prefix}_all": f"""
            SELECT S.S AS S, S.W AS W,
                   CAST(sum(CASE WHEN L THEN 1 ELSE 0 END) AS BIGINT) AS TEST_COUNT,
                   CAST(sum(CASE WHEN L THEN M ELSE 0 END) AS BIGINT) AS S_T,
                   CAST(sum(CASE WHEN NOT L THEN 1 ELSE 0 END) AS BIGINT) AS CONTROL_COUNT,
                   CAST(sum(CASE WHEN NOT L THEN M ELSE 0 END) AS BIGINT) AS S_C
            FROM {prefix}_x GROUP BY 1, 2""",
        f"{prefix}_o": f"SELECT TEST_COUNT AS NT, CONTROL_COUNT AS NC, S_T AS ST, S_C AS SC FROM {prefix}_all WHERE len(S) = 0",
        f"{prefix}_agg": f"SELECT a.* FROM {prefix}_all a CROSS JOIN {prefix}_o WHERE len(S) = 0 OR 100 * (TEST_COUNT + CONTROL_COUNT) >= NT + NC",
        f"{prefix}_part": f"""
            SELECT S, W, N, list_filter(S, lambda v, i: i <> AX) AS PS, list_filter(W, lambda v, i: i <> AX) AS PW
            FROM (SELECT S, W, TEST_COUNT + CONTROL_COUNT AS N, unnest(range(1, len(S) + 1)) AS AX FROM {prefix}_agg WHERE len(S) > 1)""",
        f"{prefix}_same": f"""
            SELECT DISTINCT p.S, p.W FROM {prefix}_part p JOIN {prefix}_agg a ON a.S = p.PS AND a.W = p.PW
            WHERE 100 * p.N >= 98 * (a.TEST_COUNT + a.CONTROL_COUNT)""",
        f"{prefix}_out": f"""
            SELECT CASE WHEN len(S) = 0 THEN '["Overall"]'
                        ELSE '[' || array_to_string(list_transform(S, lambda d, i: '"' || ({names})[d + 1] || ' = ' || W[i] || '"'), ', ') || ']'
                   END AS CONTRIBUTOR,
                   round({rc}, 6) AS METRIC_CONTROL,
                   round({rt}, 6) AS METRIC_TEST,
                   round({contrib}, 6) AS CONTRIBUTION,
                   round(CASE WHEN {change} > 0 THEN ({contrib}) / {change} END, 6) AS RELATIVE_CONTRIBUTION,
                   round(CASE WHEN ({rc}) > 0 THEN ({rt}) / ({rc}) - 1 END, 6) AS GROWTH_RATE,
                   CONTROL_COUNT, TEST_COUNT, {RUN_TS} AS MODEL_RUN_TS
            FROM {prefix}_agg a ANTI JOIN {prefix}_same s ON s.S = a.S AND s.W = a.W CROSS JOIN {prefix}_o""",
    }


EXTRA_CTES: dict[str, str] = {
    "v1": """SELECT CAST(ADMIT_DATE AS TIMESTAMP) AS TS, ENCOUNTER_TYPE, count(*) AS ENCOUNTER_COUNT
             FROM fct_encounter GROUP BY ADMIT_DATE, ENCOUNTER_TYPE""",
    "v2": """SELECT CAST(SERVICE_DATE AS TIMESTAMP) AS TS, DENIAL_CATEGORY, count(*) AS DENIAL_COUNT,
                    sum(CHARGE_AMT) AS DENIED_CHARGES
             FROM m_den GROUP BY SERVICE_DATE, DENIAL_CATEGORY""",
    "v3": f"""SELECT CASE WHEN READMIT_30_FLAG THEN 1 ELSE 0 END AS READMIT_METRIC, DRG_CODE, PAYER_TYPE, PATIENT_GENDER,
                    CASE WHEN PATIENT_AGE < 18 THEN 'PEDIATRIC' WHEN PATIENT_AGE < 40 THEN 'YOUNG_ADULT'
                         WHEN PATIENT_AGE < 65 THEN 'ADULT' WHEN PATIENT_AGE < 80 THEN 'SENIOR' ELSE 'ELDERLY' END AS AGE_BUCKET,
                    CASE WHEN HCC_SCORE IS NULL THEN 'UNKNOWN' WHEN HCC_SCORE < 0.5 THEN 'LOW'
                         WHEN HCC_SCORE < 1.0 THEN 'MODERATE' WHEN HCC_SCORE < 2.0 THEN 'HIGH' ELSE 'VERY_HIGH' END AS HCC_BUCKET,
                    DEPT_NAME, ENCOUNTER_TYPE, CAST(IS_LONG_STAY AS VARCHAR) AS IS_LONG_STAY, FACILITY_NAME,
                    DISCHARGE_DISPOSITION,
                    ADMIT_MONTH >= CAST((SELECT max(ADMIT_MONTH) FROM m_readmit) - INTERVAL {P.label_months} MONTH AS DATE) AS LABEL
             FROM m_readmit""",
    "v4": f"""SELECT CASE WHEN LEAKAGE_FLAG THEN 1 ELSE 0 END AS LEAKAGE_METRIC, REFERRED_TO_SPECIALTY,
                    REFERRING_SPECIALTY, PATIENT_PAYER_TYPE, substring(PATIENT_ZIP, 1, 3) AS ZIP_PREFIX,
                    CAST(IS_HIGH_VALUE AS VARCHAR) AS IS_HIGH_VALUE, FACILITY_NAME, STATUS,
                    REFERRAL_DATE >= CAST((SELECT max(REFERRAL_DATE) FROM m_leak) - INTERVAL {P.label_months} MONTH AS DATE) AS LABEL
             FROM m_leak""",
    # L1 forecast: least squares on trend, weekday and year over the zero-filled days
    "x_fc_daily": "SELECT ENCOUNTER_TYPE AS SERIES, CAST(TS AS DATE) AS D, CAST(sum(ENCOUNTER_COUNT) AS DOUBLE) AS Y FROM v1 GROUP BY 1, 2",
    "x_fc_b": "SELECT min(D) AS LO, max(D) AS HI FROM x_fc_daily",
    "x_fc_keys": "SELECT DISTINCT SERIES FROM x_fc_daily",
    "x_fc_dense": f"""SELECT k.SERIES, g.D, COALESCE(d.Y, 0) AS Y, {terms('g.D')} AS X
             FROM x_fc_keys k CROSS JOIN x_fc_b CROSS JOIN ({days('LO', 'HI')} FROM x_fc_b) g
             LEFT JOIN x_fc_daily d ON d.SERIES = k.SERIES AND d.D = g.D""",
    **least_squares("x_fc", "x_fc_dense"),
    "x_fc_res": f"""SELECT SERIES, sum((Y - {lin('B', 'X')}) ** 2) / greatest(count(*) - {N_TERMS}, 1) AS V
             FROM x_fc_dense JOIN x_fc_model USING (SERIES) GROUP BY 1""",
    "x_fc_out": f"""SELECT SERIES, D, {lin('B', 'X')} AS F, sqrt(V * (1 + {quad('C', 'X')})) AS E
             FROM (SELECT m.SERIES, B, C, V, g.D, {terms('g.D')} AS X
                   FROM x_fc_model m JOIN x_fc_res USING (SERIES) CROSS JOIN x_fc_b
                   CROSS JOIN ({days('HI + 1', f'HI + {P.forecast_days}')} FROM x_fc_b) g)""",
    "pred_encounter_volume": f"""
             SELECT SERIES AS ENCOUNTER_TYPE, CAST(D AS TIMESTAMP) AS FORECAST_DATE, round(F, 0) AS FORECAST_COUNT,
                    round(F - {Z} * E, 0) AS LOWER_BOUND, round(F + {Z} * E, 0) AS UPPER_BOUND, {RUN_TS} AS MODEL_RUN_TS
             FROM x_fc_out""",
    # L2 anomalies: the same model on the days before the cut, bounds by quantiles of its residuals
    "x_an_daily": """SELECT DENIAL_CATEGORY AS SERIES, CAST(TS AS DATE) AS D, CAST(sum(DENIAL_COUNT) AS DOUBLE) AS Y,
                    sum(DENIED_CHARGES) AS DENIED_CHARGES FROM v2 GROUP BY 1, 2""",
    "x_an_b": f"SELECT min(D) AS LO, CAST(max(D) - INTERVAL {P.eval_months} MONTH AS DATE) AS HI FROM x_an_daily",
    "x_an_x": f"SELECT SERIES, D, Y, DENIED_CHARGES, HI, {terms('D')} AS X FROM x_an_daily CROSS JOIN x_an_b",
    **least_squares("x_an", "(SELECT * FROM x_an_x WHERE D < HI)"),
    "x_an_fit": f"""SELECT SERIES, D, Y, DENIED_CHARGES, D < HI AS PAST, CASE WHEN N >= {2 * N_TERMS} THEN {lin('B', 'X')} END AS EXPECTED
             FROM x_an_x LEFT JOIN x_an_model USING (SERIES)""",
    "x_an_r": "SELECT *, round(Y - EXPECTED, 6) AS R FROM x_an_fit",
    "x_an_q": f"""SELECT SERIES, quantile_cont(R, 0.025) AS QL, quantile_cont(R, 0.975) AS QH, count(*) AS N
             FROM x_an_r WHERE PAST GROUP BY 1""",
    "pred_denial_anomalies": f"""
             SELECT e.SERIES AS DENIAL_CATEGORY, CAST(e.D AS TIMESTAMP) AS TS, round(e.EXPECTED, 0) AS EXPECTED_COUNT,
                    round(e.EXPECTED + QL, 0) AS LOWER_BOUND, round(e.EXPECTED + QH, 0) AS UPPER_BOUND,
                    (e.R < QL OR e.R > QH) AS IS_ANOMALY,
                    CASE WHEN e.EXPECTED IS NOT NULL THEN
                      round((SELECT sum(CASE WHEN p.R < e.R THEN 1.0 WHEN p.R = e.R THEN 0.5 ELSE 0 END) FROM x_an_r p
                             WHERE p.PAST AND p.SERIES = e.SERIES) / q.N, 4) END AS PERCENTILE,
                    CAST(e.Y AS BIGINT) AS ACTUAL_COUNT, round(e.DENIED_CHARGES, 2) AS ACTUAL_CHARGES, {RUN_TS} AS MODEL_RUN_TS
             FROM x_an_r e LEFT JOIN x_an_q q ON q.SERIES = e.SERIES WHERE NOT e.PAST""",
    **_drivers("x_d3", "v3", "READMIT_METRIC", READMISSION_DIMS),
    **_drivers("x_d4", "v4", "LEAKAGE_METRIC", LEAKAGE_DIMS),
    "pred_readmission_drivers": "SELECT * FROM x_d3_out",
    "pred_leakage_drivers": "SELECT * FROM x_d4_out",
    "pred_inventory": """
             SELECT 'PRED_ENCOUNTER_VOLUME' AS TABLE_NAME, count(*) AS ROW_COUNT FROM pred_encounter_volume
             UNION ALL SELECT 'PRED_DENIAL_ANOMALIES', count(*) FROM pred_denial_anomalies
             UNION ALL SELECT 'PRED_READMISSION_DRIVERS', count(*) FROM pred_readmission_drivers
             UNION ALL SELECT 'PRED_LEAKAGE_DRIVERS', count(*) FROM pred_leakage_drivers""",
}

TOPD = ("SELECT CONTRIBUTOR, RELATIVE_CONTRIBUTION, GROWTH_RATE FROM {t} WHERE CONTRIBUTOR <> '[\"Overall\"]' "
        "ORDER BY abs(RELATIVE_CONTRIBUTION) DESC NULLS FIRST, CONTRIBUTOR LIMIT 10")

Q: dict[str, str] = {
    "q06_dash_predictions": "SELECT CAST(sum(ROW_COUNT) AS BIGINT) AS N FROM pred_inventory",
    "q14_dash_forecast": "SELECT ENCOUNTER_TYPE, FORECAST_DATE, FORECAST_COUNT FROM pred_encounter_volume ORDER BY 1, 2",
    "q15_dash_anomalies": "SELECT TS, ACTUAL_COUNT, EXPECTED_COUNT, IS_ANOMALY, DENIAL_CATEGORY FROM pred_denial_anomalies ORDER BY TS, DENIAL_CATEGORY",
    "q48_pred_forecast": ("SELECT ENCOUNTER_TYPE, FORECAST_DATE, FORECAST_COUNT, LOWER_BOUND, UPPER_BOUND "
                          "FROM pred_encounter_volume ORDER BY 1, 2"),
    "q50_pred_anomalies": ("SELECT TS, ACTUAL_COUNT, EXPECTED_COUNT, LOWER_BOUND, UPPER_BOUND, IS_ANOMALY, DENIAL_CATEGORY "
                           "FROM pred_denial_anomalies ORDER BY TS, DENIAL_CATEGORY"),
    "q51_pred_readmit_drivers": TOPD.format(t="pred_readmission_drivers"),
    "q52_pred_leakage_drivers": TOPD.format(t="pred_leakage_drivers"),
    "q56_ops_predictions": "SELECT count(*) AS N FROM pred_encounter_volume",
    "q57_ops_anomalies": "SELECT count(*) AS N FROM pred_denial_anomalies",
    "q58_ops_pred_tables": "SELECT TABLE_NAME, ROW_COUNT FROM pred_inventory ORDER BY TABLE_NAME",
    "vq09_encounter_forecast": ("SELECT ENCOUNTER_TYPE, CAST(FORECAST_DATE AS DATE) AS FORECAST_DATE, "
                                "round(FORECAST_COUNT, 0) AS FORECAST_COUNT, round(LOWER_BOUND, 0) AS LOWER_BOUND, "
                                "round(UPPER_BOUND, 0) AS UPPER_BOUND FROM pred_encounter_volume ORDER BY 1, 2"),
    "vq10_denial_anomalies": ("SELECT DENIAL_CATEGORY, CAST(TS AS DATE) AS ANOMALY_DATE, ACTUAL_COUNT, "
                              "round(EXPECTED_COUNT, 0) AS EXPECTED_COUNT, IS_ANOMALY FROM pred_denial_anomalies "
                              "WHERE IS_ANOMALY = TRUE ORDER BY 2, 1"),
    "k1_readmit_control_chart": (
        f"SELECT b.*, round(pb * 100, 4) AS P_BAR_PCT, "
        f"round(least({dbl(100.0)}, (pb + {dbl(3.0)} * sqrt(pb * ({dbl(1.0)} - pb) / N)) * 100), 4) AS UCL, "
        f"round(greatest({dbl(0.0)}, (pb - {dbl(3.0)} * sqrt(pb * ({dbl(1.0)} - pb) / N)) * 100), 4) AS LCL, "
        f"(RATE > least({dbl(100.0)}, (pb + {dbl(3.0)} * sqrt(pb * ({dbl(1.0)} - pb) / N)) * 100) OR "
        f"RATE < greatest({dbl(0.0)}, (pb - {dbl(3.0)} * sqrt(pb * ({dbl(1.0)} - pb) / N)) * 100)) AS OUT_OF_CONTROL "
        f"FROM ({DASH['q25_readmit_fs_control']}) b "
        f"CROSS JOIN (SELECT sum(READMITS) / sum(N) AS pb FROM ({DASH['q25_readmit_fs_control']})) s"),
    "k2_readmit_facility_specialty_matrix": (
        f"PIVOT ({DASH['q22_readmit_fs_heatmap']}) ON SPECIALTY IN ({', '.join(repr(x) for x in SPECIALTIES)}) USING first(RATE) GROUP BY FACILITY_NAME"),
    "k3_or_block_weekday_matrix": (
        f"PIVOT ({DASH['q32_or_heatmap']}) ON DOW IN ({', '.join(repr(d) for d in WEEKDAYS)}) "
        "USING first(UTIL) GROUP BY BLOCK_NAME"),
    "k4_forecast_overlay": (
        f"SELECT ENCOUNTER_TYPE, DT, CAST(CNT AS DOUBLE) AS VALUE, 'actual' AS KIND FROM ({DASH['q49_pred_actuals']}) "
        "UNION ALL SELECT ENCOUNTER_TYPE, CAST(FORECAST_DATE AS DATE) AS DT, FORECAST_COUNT AS VALUE, 'forecast' AS KIND "
        "FROM pred_encounter_volume"),
    "k5_anomaly_count": "SELECT CAST(count_if(IS_ANOMALY) AS BIGINT) AS ANOMALIES FROM pred_denial_anomalies",
    "l1_pred_encounter_volume": "SELECT * FROM pred_encounter_volume",
    "l2_pred_denial_anomalies": "SELECT * FROM pred_denial_anomalies",
    "l3_pred_readmission_drivers": "SELECT * FROM pred_readmission_drivers",
    "l4_pred_leakage_drivers": "SELECT * FROM pred_leakage_drivers",
    "v1_daily_encounter_volume": "SELECT * FROM v1",
    "v2_daily_denial_volume": "SELECT TS, DENIAL_CATEGORY, DENIAL_COUNT, round(DENIED_CHARGES, 2) AS DENIED_CHARGES FROM v2",
    "v3_readmission_drivers_input": "SELECT * FROM v3",
    "v4_leakage_drivers_input": "SELECT * FROM v4",
    "v5_denial_train_eval_sizes": (
        f"SELECT 'TRAIN' AS PART, count(*) AS ROWS FROM v2 WHERE CAST(TS AS DATE) < "
        f"CAST((SELECT max(CAST(TS AS DATE)) FROM v2) - INTERVAL {P.eval_months} MONTH AS DATE) "
        f"UNION ALL SELECT 'EVAL', count(*) FROM v2 WHERE CAST(TS AS DATE) >= "
        f"CAST((SELECT max(CAST(TS AS DATE)) FROM v2) - INTERVAL {P.eval_months} MONTH AS DATE)"),
}

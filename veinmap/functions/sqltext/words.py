"""Word sets of the grammar."""

from __future__ import annotations


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# They decide what ends an expression, what can't be an alias and what isn't a column.
STOP = _set(
    "SELECT FROM WHERE GROUP HAVING ORDER UNION INTERSECT MINUS EXCEPT CONNECT START INTO VALUES SET ON USING JOIN INNER LEFT RIGHT FULL "
    "CROSS NATURAL OUTER WHEN THEN ELSE END FETCH OFFSET RETURNING LOG MODEL PIVOT UNPIVOT WINDOW FOR AS WITH"
)
OPERATOR = _set("AND OR NOT IS IN LIKE LIKE2 LIKE4 LIKEC BETWEEN ESCAPE EXISTS PRIOR ANY SOME ALL DISTINCT UNIQUE MEMBER OF SUBMULTISET MULTISET COLLATE")
NOISE = _set("BY LEADING TRAILING BOTH SETS")
ORDERING = _set("ASC DESC NULLS FIRST LAST")
WINDOWING = _set("PARTITION BY ORDER ROWS RANGE GROUPS BETWEEN UNBOUNDED PRECEDING FOLLOWING CURRENT ROW EXCLUDE TIES OTHERS NO DENSE_RANK SIBLINGS KEEP")
PSEUDO = _set(
    "NULL TRUE FALSE SYSDATE SYSTIMESTAMP CURRENT_DATE CURRENT_TIMESTAMP LOCALTIMESTAMP ROWNUM LEVEL USER UID ROWID DBTIMEZONE SESSIONTIMEZONE "
    "ORA_ROWSCN CONNECT_BY_ISLEAF CONNECT_BY_ISCYCLE"
)
AGGREGATE = _set(
    "SUM COUNT MIN MAX AVG LISTAGG MEDIAN STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP COLLECT XMLAGG JSON_ARRAYAGG JSON_OBJECTAGG "
    "CORR COVAR_POP COVAR_SAMP PERCENTILE_CONT PERCENTILE_DISC APPROX_COUNT_DISTINCT APPROX_SUM APPROX_MEDIAN ANY_VALUE REGR_SLOPE REGR_INTERCEPT "
    "STATS_MODE BIT_AND_AGG BIT_OR_AGG BIT_XOR_AGG"
)
NOT_ALIAS = STOP | OPERATOR | _set("PIVOT UNPIVOT PARTITION SUBPARTITION SAMPLE LATERAL APPLY MATCHED NOCYCLE")
SET_OPERATOR = _set("UNION INTERSECT MINUS EXCEPT")
JOIN_WORD = _set("JOIN INNER LEFT RIGHT FULL CROSS NATURAL")
AFTER_FROM = SET_OPERATOR | _set("WHERE GROUP HAVING ORDER CONNECT START MODEL WINDOW FETCH OFFSET FOR ON USING WHEN SET VALUES RETURNING LOG WITH SELECT QUALIFY")
AFTER_ITEM = SET_OPERATOR | _set("FROM INTO BULK WHERE GROUP ORDER FETCH OFFSET")
INTERVAL_UNIT = _set("YEAR MONTH DAY HOUR MINUTE SECOND TO")
VIEW_OPTION = _set("FORCE NO NOFORCE EDITIONABLE NONEDITIONABLE EDITIONING MATERIALIZED GLOBAL PRIVATE TEMPORARY SHARDED DUPLICATED")
BLOCK_START = _set("BEGIN DECLARE THEN ELSE LOOP IS AS")
BLOCK_CONTROL = _set("END IF ELSIF WHILE FOR RETURN NULL COMMIT ROLLBACK EXCEPTION WHEN RAISE EXIT OPEN CLOSE FETCH GOTO PRAGMA SELECT EXECUTE CASE CONTINUE")

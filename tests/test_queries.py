import duckdb
import pytest
from pyspark.ml.classification import GBTClassifier

import __spark_entry__ as entry
import check
from riskfeat.models.boosting import Booster
from riskfeat.models.random_cuts import RandomCutForest

ORACLE = entry.oracle_sql()
# learned scores: the fits are slow and tests/test_models.py covers them
QUICK_ROWS_ONLY = ["score_logistic", "score_forest"]


@pytest.fixture(scope="module")
def duck(data_dir) -> duckdb.DuckDBPyConnection:
    return check.connect(data_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, data_dir, name):
    df = entry.queries()[name](spark, data_dir)
    assert check.difference(df.toPandas(), duck.execute(ORACLE[name]).df()) is None
    assert check.type_difference(df, duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", QUICK_ROWS_ONLY)
def test_learned_scores(spark, data_dir, name):
    scores = [r.score for r in entry.queries()[name](spark, data_dir).collect()]
    assert scores and all(0 <= s <= 1 for s in scores)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["id", "split", "target"]


SETTINGS = {
    "score_gbt": {800}, "score_gbt_categorical": {2000}, "score_forest": {1000}, "cross_validate_auc": {1000},
    "stack_oof": {700, 800, 1200, 2000}, "score_wide": {800}, "score_anchored": {800}, "validate_wide": {800},
    "validate_anchored": {800}, "score_stacked": {700, 800, 1200, 2000},
}


@pytest.mark.parametrize("name", SETTINGS)
def test_learned_scores_train_in_full(spark, data_dir, monkeypatch, name):
    """The fits are recorded, not run."""
    grown = set()

    def fit(self, *_):
        grown.add(self.trees if isinstance(self, RandomCutForest) else self.rounds if isinstance(self, Booster) else self.getMaxIter())
        raise InterruptedError

    for learner in (GBTClassifier, RandomCutForest, Booster):
        monkeypatch.setattr(learner, "fit", fit)
    with pytest.raises(InterruptedError):
        entry.queries()[name](spark, data_dir)
    assert grown == SETTINGS[name]


def test_validate_categorical_trains_in_full(spark, data_dir, monkeypatch):
    """All 2000 rounds of the setting; the fit is recorded, not run."""
    grown = []

    def fit(self, *_):
        grown.append(self.rounds)
        raise InterruptedError

    monkeypatch.setattr(Booster, "fit", fit)
    with pytest.raises(InterruptedError):
        entry.queries()["validate_categorical"](spark, data_dir)
    assert grown == [2000]

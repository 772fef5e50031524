from lattico.plans import queries
from tests.conftest import DATA


def test_every_request_is_answered(spark):
    d = f"{DATA}/sf0.001"
    assert queries.request_answers_json(spark, d).count() == 3 * spark.read.parquet(f"{d}/events.parquet").count()

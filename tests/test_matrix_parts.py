from corpusmill.operators import layers


def test_matrix_of_more_rows_than_a_part(spark):
    n = layers.MATRIX_ROWS + 5
    matrix = spark.range(n).selectExpr("id as label", "array(double(id), 1.0D) as weights")
    vectors = spark.createDataFrame([(1, [2.0, 3.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["label"]): r["y"] for r in layers.matrix_product(vectors, matrix, "vec_id", "embedding", "label", "weights").collect()}
    assert got == {(k, i): a * i + b for k, a, b in ((1, 2.0, 3.0), (2, 0.0, 1.0)) for i in range(n)}

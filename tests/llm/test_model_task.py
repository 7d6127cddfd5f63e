"""The toxicity model is fitted by a task."""

import numpy as np

from linkscope.llm import string_kernel_svm


def test_driver_fits_nothing(spark, monkeypatch):
    rows = [(i, f"you are a {'stupid idiot' if i % 3 == 0 else 'good friend of mine'} number{i % 7}", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, _, v in rows], "doc_id long, toxic int")
    known = string_kernel_svm.fit([t for _, t, _ in rows], [v for *_, v in rows])

    def here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(string_kernel_svm, "fit", here)
    model = string_kernel_svm.train(docs, labels)
    assert np.array_equal(model.weight, known.weight) and model.bias == known.bias and np.array_equal(model.logistic, known.logistic)
    none = string_kernel_svm.train(docs.limit(0), labels)
    assert not none.weight.any() and none.logistic[2] == -60

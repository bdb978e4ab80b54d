from quire.sources import requests


def test_request_documents(spark, scratch):
    import os
    docs = {"a.json": '{"organization_id": "o1", "report_name": "R", "submission_ids": [1, 2, 3]}',
            "c.json": '{"organization_id": "o3", "report_name": "T", "submission_ids": ["12", 7, "13", 7]}',
            "d.json": '{"organization_id": "o4", "report_name": "U", "submission_ids": "5"}',
            "e.json": '{"organization_id": "o5", "report_name": "V", "submission_ids": [1, "x", null]}',
            "b.json": '{\n  "organization_id": "o2",\n  "report_name": "S",\n  "submission_ids": 9\n}'}
    for name, text in docs.items():
        with open(os.path.join(scratch, name), "w") as f:
            f.write(text)
    req = requests.parse_requests(requests.read_request_documents(spark, scratch))
    got = sorted(tuple(r) for r in requests.request_ids(req).collect())
    assert got == [("o1", "R", 0, 1), ("o1", "R", 1, 2), ("o1", "R", 2, 3), ("o2", "S", 0, 9), ("o3", "T", 0, 12), ("o3", "T", 1, 7),
                   ("o3", "T", 2, 13), ("o3", "T", 3, 7), ("o4", "U", 0, 5), ("o5", "V", 0, 1)]
    assert sorted((r.report_name, r.position, r.text) for r in requests.invalid_ids(req).collect()) == [("V", 1, "x"), ("V", 2, None)]


def test_requests_from_orders(spark):
    orders = spark.createDataFrame([(4,), (5,)], "o_orderkey long")
    ids = requests.request_ids(requests.parse_requests(requests.requests_from_orders(orders, "1", "r")))
    assert sorted(r.submission_id for r in ids.collect()) == [4, 5]

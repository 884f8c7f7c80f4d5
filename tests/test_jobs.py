import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.functions import formats as R
from lexweave.operators import jobs as J
from lexweave.operators.chunking import chunk, document_summary
from lexweave.operators.completion import client, language_answer, mock, says_equivalent
from lexweave.operators.reconcile import discrepancies, resolved_chunks
from lexweave.sources.office import markdown_of_html, office_files


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column).first()[0]


def test_headings_close_chunks(spark):
    df = spark.createDataFrame([(1, "A one. A two.\n\n# H\n\nB.\n\nC c c c c c c c c c.")], "id long, text string")
    rows = chunk(df, "id", "text", 20, 1).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["A one. A two.", "# H\n\nB.", "B.\n\nC c c c c c c c c c."]
    assert [r["heading_context"] for r in rows] == ["", "# H", "# H"]
    assert value(spark, document_summary(F.col("t")), t="short") == "short"


def test_formats(spark):
    assert value(spark, R.export_format(F.col("t")), t="a/b.markdown") == "md"
    assert value(spark, R.export_format(F.col("t")), t="a.xls") == "pdf"
    assert value(spark, R.ocr_language(F.col("t")), t="chi_sim+eng") == "zh"
    assert value(spark, R.selector(F.col("t")), t="composer-2.5") == "cursor:composer-2.5"
    assert value(spark, R.cost(F.col("t"), F.lit(18420), F.lit(16200)), t="cursor:composer-2.5") == pytest.approx(0.185025)
    assert value(spark, R.cost(F.col("t"), F.lit(1), F.lit(1)), t="no:price") is None
    assert value(spark, R.without_front_matter(F.col("t")), t="---\nx: 1\n---\n\nbody") == "body"
    assert value(spark, R.without_front_matter(F.col("t")), t="---\nx") == "---\nx"
    assert value(spark, R.rtf_text(F.col("t")), t=r"{\rtf1 Hello\par}") == "Hello"


def test_answers(spark):
    for raw, want in (('{"equivalent": true}', True), ('x {"equivalent": "false"} y', True), ('{"equivalent": false}', False), ('{"equivalent": 0}', False), ("{}", False), ("not json", False)):
        assert value(spark, F.coalesce(says_equivalent(F.col("t")), F.lit(False)), t=raw) is want
    assert value(spark, language_answer(F.col("t")), t=" EN. ") == "en" and value(spark, language_answer(F.col("t")), t="1") == "unknown"


def test_client_retries(spark):
    def factory():
        seen = []

        def ask(system, user):
            seen.append(user)
            if len(seen) < 3:
                raise ConnectionError
            return system + user

        return ask

    assert value(spark, client(factory, base=0.0)(F.lit("s"), F.col("t")), t="u") == "su"


def test_reconcile(spark):
    chunks = spark.createDataFrame([(1, 0, "Uno. Dos.", "One is here. Pay $100.", "One is here. Pay $2000."), (1, 1, "x", "", "Only two."), (1, 2, "Same.", "Same.", "Same.")], "doc_id long, chunk_index int, source string, t1 string, t2 string")
    found = discrepancies(chunks, mock())
    texts = {r["chunk_index"]: r["text"] for r in resolved_chunks(chunks, found).collect()}
    assert texts == {0: "One is here. Pay $2000.", 1: "Only two.", 2: "Same."}
    asked = mock(responses={"Pay $2000.\n\nVariant 3": '{"resolved_text": "Pay $150.", "rationale": "r"}', "Translation 2:\nPay": '{"equivalent": false, "severity": "breaking", "explanation": "amount"}'})
    row = [r for r in discrepancies(chunks, asked).collect() if r["chunk_index"] == 0][0]
    assert (row["severity"], row["resolution"], row["explanation"], row["source_span"], row["translation_3"]) == ("breaking", "Pay $150.", "amount; r", "Dos.", "[EN] Dos.")


def test_rollups(spark):
    issues = spark.createDataFrame([("a", i, "warn", f"m{i}") for i in range(6)] + [("b", 0, "info", "x")], "job_id string, pos int, severity string, message string")
    assert {r["job_id"]: r["warnings"] for r in J.top_warnings(issues).collect()} == {"a": ["m0", "m1", "m2"]}
    found = spark.createDataFrame([("a", i, "breaking", False, "" if i == 0 else f"e{i}") for i in range(8)], "job_id string, pos int, severity string, resolved boolean, explanation string")
    assert J.review_items(found, "job_id").first()["items"] == [J.REVIEW_DEFAULT, "e1", "e2", "e3", "+ 4 more item(s) listed in the job metadata."]
    none = spark.createDataFrame([], "passed boolean")
    assert J.qa_summary(none).first()["pass_rate"] == 100.0
    assert J.batch_status(spark.createDataFrame([], "status string")).first()["exit_code"] == 0


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>Hello DOCX world</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("c1.xhtml", "<html><head><title>no</title></head><body><h1>One</h1><p>a &amp; b</p></body></html>")
    (tmp_path / "c.odt").write_bytes(b"no zip")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in office_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"]["text"] == "# T\n\nHello DOCX world"
    assert rows["b.epub"]["text"] == "# One\n\na & b"
    assert rows["c.odt"]["text"] is None and "BadZipFile" in rows["c.odt"]["error"]
    assert markdown_of_html("<ul><li>x</li><li>y</li></ul>") == "- x\n- y"

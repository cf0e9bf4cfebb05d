"""Written cases of rules over postings, pages, answers and resumes: what is given and what each must give."""

import json

from pyspark.sql import functions as F

from demandlens.operators import answers as A
from demandlens.operators import canonical as K
from demandlens.sources import parsers as P


CASES: list[tuple] = []


def cases(name: str, pairs: list[tuple], f):
    """f takes rows (id, x) to rows (id, value); pairs are what x is and what value must be."""
    CASES.append((name, pairs, f))


def each(name: str, pairs: list[tuple], f):
    cases(name, pairs, lambda rows: rows.select("id", f(F.col("x")).alias("value")))


# --- canonical jobs
each("clean_text", [("  a \n b ", "a b"), ("N/A", None), (" — ", None), ("Not  Specified", None), ("none of it", "none of it"), ("", None), (None, None)], K.clean)
each("norm_job_type_canonical", [("Full_Time", "FULL_TIME"), ("permanent", "FULL_TIME"), ("co/op", "INTERNSHIP"), ("Part.time", "PART_TIME"), ("Co-Op", "INTERNSHIP"), ("TEMP", "TEMPORARY"), ("contractor", "CONTRACT"),
     ("Fixed term-ish", "FIXED_TERM_ISH"), ("unknown", None), (None, None)], K.job_type)
each("norm_location", [("WFH", "Remote"), ("remote - US", "Remote"), ("Can work from home", "Remote"), ("Hybrid_Remote", "Hybrid"), ("In Office", "On-site"), ("  Berlin,  Germany", "Berlin, Germany"), ("undefined", None), (None, None)], K.location)
each("location_value", [('{"name": "Berlin"}', "Berlin"), ('{"city": "Oslo", "x": 1}', "Oslo"), ('[{"name": "Rome"}, "n/a", "wfh"]', "Rome, wfh"), ("true", "Remote"), ("false", None), ("[]", None), ("Paris", "Paris")], K.place)
each("infer_job_type", [("Summer intern, full time", "INTERNSHIP"), ("CO OP", "INTERNSHIP"), ("a part-time contract", "PART_TIME"), ("contractors", None), ("contractor", "CONTRACT"), ("Temporary help", "TEMPORARY"), ("fulltime", "FULL_TIME"), ("", None)], K.infer_job_type)
each("infer_job_label", [("Summer internship, full time", "Full-time"), ("intern", ""), ("CO OP", "Internship"), ("part time contractor", "Part-time"), ("Contract", "Contract"), ("temp", "Temporary"), ("", ""), (None, "")], lambda x: P.job_label(x))
each("job_id_from_url", [("https://www.linkedin.com/jobs/view/123/?x=1", "123"), ("/jobs-guest/jobs/api/jobPosting/77", "77"), ("https://x/?a=b&currentJobId=9", "9"), ("/jobs/view/a", ""), ("", "")], P.job_id)
each("entities", [("a &amp;lt; b &lt; &#233;&#xe9; &#X1F600;", "a &lt; b < éé 😀"), ("&quot;x&apos;", "\"x'"), ("&#0; &bogus;", "&#0; &bogus;"), (None, None)], P.unescaped)
each("html_to_text_lines", [("<ul><li>One &amp; two</li><li> three</li></ul><p>four<br>five</p>", "One & two\nthree\nfour five"), ("<script>if (a<b) x()</script>t", "t"), ("", "")], lambda x: P.page_text(x, True))
each("board_text", [("&lt;p&gt;Hello&lt;/p&gt; &lt;b&gt;you&lt;/b&gt;", "Hello you"), ("<p>a</p>", "a"), (None, "")], P.board_text)
each("parse_iso_ts", [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"), ("2024-01-02 03:04", "2024-01-02 03:04:00"), ("2024-01-02", "2024-01-02 00:00:00"), ("2024-02-30", None), ("soon", None), (None, None)],
     lambda x: F.date_format(P.iso_time(x), "yyyy-MM-dd HH:mm:ss"))
each("config_bool", [('{"a": true}', "true"), ('{"b": " Yes "}', "true"), ('{"a": "no", "b": "yes"}', "false"), ('{"a": 1}', "true"), ("{}", "true"), ('{"a": "off"}', "false")], lambda x: K.config_bool(x, ["a", "b"], True).cast("string"))
each("merge_config", [("a", "a=2,b=1,c=3"), ("b", "b=9,c=3")], lambda x: F.array_join(F.array_sort(F.transform(F.map_entries(K.merged_config(
    F.when(x == "a", F.from_json(F.lit('{"a": "1", "b": "1"}'), "map<string,string>")).otherwise(F.from_json(F.lit('{"b": "9"}'), "map<string,string>")),
    F.when(x == "a", F.from_json(F.lit('{"a": "2", "c": "3"}'), "map<string,string>")).otherwise(F.from_json(F.lit('{"c": "3"}'), "map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))
each("rolling_window_pick", [("a,b,c,d|3|2", "d,a"), ("a,b|1|5", "b,a"), ("|0|2", ""), ("a,b,c|7|2", "b,c")], lambda x: F.array_join(P.picked_window(
    F.filter(F.split(F.element_at(F.split(x, r"\|"), 1), ","), lambda s: s != ""), F.element_at(F.split(x, r"\|"), 2).cast("int"), 2), ","))
each("picked_language", [('{"de": "a", "en": "b"}', "b"), ('{"de": "a", "en-gb": "c", "en-us": "d"}', "d"), ('{"de": "a"}', "a"), ('{"en": "", "fr": "x"}', "x"), ("{}", None)], lambda x: P.picked_language(F.from_json(x, "map<string,string>")))
each("link_uris", [('{"b": [{"uri": "u1"}, {"uri": "u2"}], "a": [{"uri": "u0"}]}', "u0,u1,u2"), ('{"c": [{"uri": "u9"}]}', ""), ("{}", "")],
     lambda x: F.array_join(P.link_uris(F.from_json(x, "map<string,array<struct<uri:string>>>"), ["a", "b"]), ","))

RAW = [
    ({"jobTitle": " Data  Engineer ", "company": {"name": "x"}, "url": "n/a", "link": "https://a/1", "id": 7, "type": "co-op", "locations": [{"name": "Rome"}, "wfh"], "about_role": "We do.", "sections": {"about": "old", "perks": "Tea"}},
     'Data Engineer|{"name":"x"}|https://a/1|7|INTERNSHIP|Rome, wfh||We do.\n\nTea'),
    ({"title": "Nurse", "employer": "unknown", "description": "A part time role.", "remote": True, "url": "https://b"}, "Nurse|Default Co|https://b||PART_TIME||Remote|A part time role."),
    ({"name": "Cook", "organization": "Inn", "employment_type": "Seasonal work", "workplaceType": "on_site", "location": "-"}, "Cook|Inn|||SEASONAL_WORK||On-site|"),
    ({"title": "Clerk", "company_name": "Bank", "metadata": {"default_job_type": "temp"}, "body": "x"}, "Clerk|Bank|||TEMPORARY|||x"),
    ({"title": "Guard", "company": "Q", "content": "y"}, "Guard|Q|||FULL_TIME|||y"),
]


def _canonical(rows):
    staged = rows.select("id", F.col("x").alias("raw"), F.lit("A source").alias("source_name"), F.lit("Default Co").alias("default_company"), F.lit("permanent").alias("default_job_type"), F.lit(False).alias("filters_types"))
    made = K.canonicalize(staged)
    shown = [F.coalesce(c, F.lit("")) for c in ("title", "company_name", "source_url", "external_id", "job_type", "location", "remote_type", "description")]
    return made.select("id", F.concat_ws("|", *shown).alias("value"))


cases("canonicalize", [(json.dumps(x), w) for x, w in RAW], _canonical)
cases("validate_payload", [("T|C|u|", ""), ("|C||9", "title"), ("T|||", "company_name, source_url_or_external_id"), ("| | |", "title, company_name, source_url_or_external_id")],
      lambda rows: K.missing_fields(rows.select("id", *[F.element_at(F.split("x", r"\|"), k + 1).alias(c) for k, c in enumerate(("title", "company_name", "source_url", "external_id"))])).select("id", F.col("missing").alias("value")))
JOB = "title string, company_name string, location string, remote_type string, description string, employment_type string, job_type string, sections map<string,string>"


def filtered(name: str, settings: dict, pairs: list[tuple[dict, bool]]):
    cases(name, [(json.dumps(j), "true" if w else "false") for j, w in pairs], lambda rows: rows.select("id", F.from_json("x", JOB).alias("j")).select("id", "j.*").select("id", F.coalesce(K.source_filter(settings), F.lit(False)).cast("string").alias("value")))


filtered("flt_location", {"locations": ["New_York", "CA", " "]}, [({"location": "new york city"}, True), ({"location": "LA, CA (remote)"}, True), ({"location": "Canada"}, False), ({"location": ""}, False), ({}, False), ({"location": "CA"}, True)])
filtered("flt_workplace", {"workplace_types": ["Remote", "on_site", "odd"]}, [({"remote_type": "REMOTE"}, True), ({"description": "office"}, True), ({"location": "hybrid, Oslo"}, False), ({"location": "hybrid", "description": "or remote"}, True), ({}, True)])
filtered("flt_job_type", {"job_types": ["full time", "n/a", "Co-op"]}, [({"employment_type": "permanent"}, True), ({"job_type": "INTERNSHIP"}, True), ({"employment_type": "contract"}, False), ({}, False), ({"employment_type": "x", "job_type": "Full-Time"}, True)])
filtered("source_filter", {"target_companies": ["Acme, Inc."], "include_keywords": ["C++", "data engineer", "co-op"], "exclude_keywords": ["senior"]},
         [({"company_name": "ACME", "title": "Data  Engineer"}, False), ({"company_name": "Acme LLC", "title": "Data Engineer"}, True), ({"company_name": "Acme Ltd.", "title": "x", "sections": {"a": "a coop place"}}, True), ({"company_name": "Acme inc.", "title": "Senior data engineer"}, False),
          ({"company_name": "Other", "title": "data engineer"}, False), ({"company_name": "acme", "title": "mydata engineers"}, False), ({"title": "data engineer"}, False)])

# --- pages
CARDS = ("<div data-entity-urn=\"urn:li:jobPosting:11\"><h3 class='base-search-card__title'> Data &amp; AI </h3><h4 class=\"x base-search-card__subtitle\">Acme</h4><span class=\"job-search-card__location\">Oslo</span> full time <time datetime=\"2024-01-02\"></time></div>"
         "<DIV data-entity-urn='urn:li:jobPosting:12'><h3 class='base-search-card__title'>Cook</h3></DIV><div data-entity-urn=\"urn:li:jobPosting:11\">again</div>")  # fmt: skip
DETAIL = ("<h1 class=\"top-card-layout__title\">Chef</h1><a class='topcard__org-name-link'>Inn</a><span class='topcard__flavor--bullet'>Rome</span><div class=\"show-more-less-html__markup\">One<br>two</div><time class='t' datetime='2024-05-06'>"
          "<li class='description__job-criteria-item'><h3 class='description__job-criteria-subheader'>Employment type</h3><span class='description__job-criteria-text'>Part-time</span></li>")  # fmt: skip
cases("html_cards", [(CARDS, "11:Data & AI:Acme:Oslo:Full-time:2024-01-02;12:Cook::::"), ("<p>nothing</p>", None), (None, None)],
      lambda rows: rows.select("id").join(P.search_cards(rows.selectExpr("id AS page_id", "x AS html")).groupBy(F.col("page_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "job_id", *[F.coalesce(c, F.lit("")) for c in ("title", "company", "location", "job_type", "posted_at")]))), ";").alias("value")), "id", "left"))
cases("html_detail", [(DETAIL, "Chef|Inn|Rome|Part-time|One two|2024-05-06"), ("<h1>Plain</h1> a full time job <div class='show-more-less-html__markup'>part time</div>", "Plain|||Full-time|part time|"), ("", "|||||")],
      lambda rows: P.job_pages(rows.selectExpr("id AS page_id", "x AS html")).select(F.col("page_id").alias("id"), F.concat_ws("|", *[F.coalesce(F.replace(F.col(c), F.lit("\n"), F.lit(" ")), F.lit("")) for c in ("title", "company", "location", "job_type", "description", "posted_at")]).alias("value")))
BOARD = {"jobs": [{"id": 5, "title": "Intern", "location": {"name": "Oslo"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "absolute_url": "https://g/5", "first_published": "2024-01-30T00:00:00Z"}, {"id": 6, "title": "Lead", "company_name": "Own", "location": "Remote", "updated_at": "2023-01-01"}]}
SHOW = lambda: F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("external_id", "title", "company_name", "source_url", "location", "description", "job_type")])
cases("greenhouse_rows", [(json.dumps(BOARD), "5|Intern|Acme Labs|https://g/5|Oslo|Hi|Internship;6|Lead|Own||Remote||"), ('{"jobs": []}', None), ("{}", None)],
      lambda rows: rows.select("id").join(P.board_jobs(rows.selectExpr("concat('acme-labs', '') AS board_token", "x AS payload", "id")).withColumn("value", SHOW()).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ";").alias("value")).withColumnRenamed("key", "id"), "id", "left"))
POSTED = (["intern", "lead"], ["Internship"], False, "Past Week", "2024-02-01 00:00:00")
cases("gh_filter", [("Intern|internship|2024-01-30T00:00:00Z|", "true"), ("Intern|Internship|2024-01-01|", "false"), ("Leader||never|", "true"), ("Cook|Internship||", "false"), ("Lead|Contract||", "false"), ("Lead|||2023-05-05", "false")],
      lambda rows: rows.select("id", *[F.element_at(F.split("x", r"\|"), k + 1).alias(c) for k, c in enumerate(("title", "job_type", "first_published", "updated_at"))], F.lit("").alias("location")).select("id", P.board_filter(*POSTED).cast("string").alias("value")))
cases("configured_jobs", [('{"raw_jobs": [{"title": "a"}, {"title": "b"}], "jobs": [{"title": "c"}]}', "0:a,1:b"), ('{"jobs": [{"title": "c"}]}', "0:c"), ("{}", None)],
      lambda rows: rows.select("id").join(P.inline_jobs(rows.selectExpr("id AS source_id", "x AS crawl_config")).groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("ord").cast("string"), F.lit(":"), F.get_json_object("raw", "$.title")))), ",").alias("value")), "id", "left"))
cases("search_url_expansion", [("a,b|x|r,h|", "a.x.r.,a.x.h.,b.x.r."), ("|||t", "...t"), ("a,a|y,z||", "a.y..,a.z..")],
      lambda rows: P.search_combinations(rows.select(F.col("id").alias("source_id"), *[F.filter(F.split(F.element_at(F.split("x", r"\|"), k + 1), ","), lambda s: s != "").alias(c) for k, c in enumerate(("keywords", "locations", "workplaces", "job_types"))]), 3)
      .groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(".", "keyword", "location", "workplace", "job_type").alias("v")))), lambda x: x["v"]), ",").alias("value")))

# --- answers and resumes
EXTRACT = [
    ({"candidate_skills": ["python", {"name": "PYTHON"}, {"skill": "data lake", "confidence": "High", "source_fragment": " a  b "}, "Go", "rust"]}, "1:Python::,2:Data Lake:0.9:a b,3:Go::"), ({"skills": [{"name": "sql", "confidence": 0.4}]}, "1:SQL:0.4:"),
    ({"candidate_skills": []}, "no skills"), ({"skills": ["x", {"name": " "}]}, "empty name"), ([1], "malformed"), (None, "malformed"),
]
cases("parse_extract", [(json.dumps(x), w) for x, w in EXTRACT] + [("{broken", "malformed")], lambda rows: A.parse_extracted(rows.selectExpr("id", "x AS payload"), 3).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(
    F.coalesce("error", F.concat_ws(":", F.col("at").cast("string"), "name", F.coalesce(F.col("confidence").cast("string"), F.lit("")), F.coalesce("fragment", F.lit("")))))), ",").alias("value")))
VERIFY = [({"verified_skills": ["go", "Go", "rust"], "rejected_skills": ["RUST", "vb", "c", "d", "e"]}, "+Go,+Rust,-C,-Vb"), ({"verified_skills": ["a", "b", "c", "d", "e"], "rejected_skills": ["f"]}, "+A,+B,+C,+D"), ({"rejected_skills": [{"name": "x", "reason": "no"}]}, "-X"), ({}, None)]
cases("parse_verify", [(json.dumps(x), w) for x, w in VERIFY], lambda rows: rows.select("id").join(A.parse_verified(rows.selectExpr("id", "x AS payload"), 4).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.when(F.col("verified"), "+").otherwise("-"), "name"))), ",").alias("value")), "id", "left"))
cases("parse_map", [('{"canonical": " Py  thon ", "confidence": 1.7, "reason": "r"}', "Py thon|1.0|r|"), ('{"canonical": "", "reason": null}', "|0.0||"), ('{"confidence": "high"}', "|||confidence"), ("nope", "|||malformed")],
      lambda rows: A.parse_mapped(rows.selectExpr("id", "x AS payload")).select("id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("canonical", "confidence", "reason", "error")]).alias("value")))
cases("section_fragments", [('{"about": "x", "perks": "  ", "needs": "y"}', "about=x,needs=y"), ("{}", None)], lambda rows: rows.select("id").join(A.section_fragments(rows.select("id", F.from_json("x", "map<string,string>").alias("sections")))
      .groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", "text"))), ",").alias("value")), "id", "left"))
cases("resume_sections", [("Ann Lee\n\nSkills:\n go \nrust\nWork Experience\nAcme\nTECHNICAL SKILLS\nsql", "experience=Acme|resume=Ann Lee|skills=go/rust/sql"), ("Summary\r\n x ", "summary=x"), ("", None), (None, None)],
      lambda rows: rows.select("id").join(A.resume_sections(rows.selectExpr("id", "x AS text")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "section", F.replace("text", F.lit("\n"), F.lit("/"))))), "|").alias("value")), "id", "left"))


def _lists(rows):
    cut = [F.filter(F.split(F.element_at(F.split("x", r"\|"), k + 1), ","), lambda s: s != "").alias(c) for k, c in enumerate(("verified", "mapped", "expected", "expected_mapped", "reject", "any_of"))]
    return rows.select(F.col("id").alias("run"), *cut, F.lit(1).alias("minimum_verified"))


cases("gold_eval", [("Go,sql|SQL|go|sql|vb|rust,GO", "true|||"), ("go||go,sql|c|go|", "false|sql|c|go"), ("|go|||| ", "false|||"), ("go|||||rust", "false|||")],
      lambda rows: A.evaluate(_lists(rows)).select(F.col("run").alias("id"), F.concat_ws("|", F.col("passed").cast("string"), *[F.array_join(c, ",") for c in ("missing_expected", "missing_mapped", "rejected_present")]).alias("value")))
cases("eval_accepted", [("Go,sql|SQL, rust||||", "go,rust,sql"), ("|||||", "")], lambda rows: A.evaluate(_lists(rows)).select(F.col("run").alias("id"), F.array_join("accepted", ",").alias("value")))

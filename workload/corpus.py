"""Raw billing documents derived from ``orders`` by one SQL text that Spark and DuckDB both run.

Every order becomes one file of one of the five source formats, with the defects real feeds have:
missing segments, repeated segments, carriage returns, truncated JSON, weak scans, empty bodies.
One scan, no join, no shuffle: the corpus grows with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimflow.sources.landing import spread

NL = "chr(10)"
#: Orders that one task makes into documents.
TASK_ROWS = 20_000


def pick(words: str, index: str) -> str:
    n = words.count(",") + 1
    return f"split_part('{words}', ',', cast(1 + ({index}) % {n} AS int))"


def block(page: int, text: str, digit: int) -> str:
    return (f"concat('{{\"page\": {page}, \"text\": \"', {text}, '\", \"confidence\": ', cb, '.{digit}}}')")


def cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def quote(text: str) -> str:
    return "'" + text + "'"


DX = "M54.5,J45.901,E11.9,I10,K21.9,F41.1,N39.0,G43.909,M17.11,J06.9,R07.9,I21.9,m54.5"
PX = "99213,99214,99203,93000,94640,71046,80053,97110,45378,73721,99285,12"

BASE = f"""
base AS (
  SELECT k, j, src, cast(k AS string) AS ks, charge,
    {pick(DX, 'j')} AS dx1, {pick(DX, 'j * 5 + 1')} AS dx2,
    {pick(PX, 'j * 5')} AS px1, {pick(PX, 'j * 7 + 3')} AS px2,
    {pick('CO-4,CO-16,CO-50,CO-97,PR-1,co-11', 'j * 5')} AS carc,
    {pick('BCBS-TX,AETNA-001,UHC-002,CIGNA-03,HUMANA-04', 'cust')} AS payer,
    {pick('Aetna,Cigna,Blue Cross Blue Shield of Texas', 'cust')} AS payer_name,
    CASE WHEN j % 31 = 0 THEN '9876543210' WHEN j % 37 = 1 THEN '12345'
      ELSE concat('1', lpad(cast(cust AS string), 9, '0')) END AS npi,
    {pick('JANE,ROBERT,MARIA,DAVID,AISHA,WEI,OLGA', 'j')} AS fn,
    replace({pick('SMITH,O~BRIEN,GARCIA,VAN DYK,PATEL-LEE,NGUYEN', 'j')}, '~', chr(39)) AS ln,
    {pick('Jane Smith,Robert Garcia,Maria Patel,Wei Nguyen,Olga Young', 'j')} AS nm,
    cast(40 + j % 59 AS string) AS cb
  FROM (SELECT o_orderkey AS k, cast((o_orderkey - o_orderkey % 5) / 5 AS bigint) AS j,
      o_custkey AS cust, cast(cast(o_totalprice AS decimal(18,2)) AS string) AS charge,
      {pick('edi837,hl7v2,webhook,fax,fhir_r4', 'o_orderkey')} AS src
    FROM orders) o
)"""

EDI = cat(
    quote("ISA*00*          *00*          *ZZ*SENDER*ZZ*RCMPLATFORM*240108*1200*^*00501*1*0*P*:~"), NL,
    quote("ST*837*0001*005010X222A1~"), NL,
    "'NM1*85*2*MERCY CLINIC*****XX*'", "npi", "'~'", NL,
    "'NM1*IL*1*'", "ln", "'*'", "fn", "'****MI*MRN-'", "ks", "'~'", NL,
    "CASE WHEN j % 23 = 6 THEN '' ELSE concat('NM1*QC*1*', ln, '*', fn, '*', "
    "CASE WHEN j % 3 = 0 THEN 'A' ELSE '' END, '***MI*MRN-', ks, '~', chr(10)) END",
    "'DMG*D8*'", "CASE WHEN j % 9 = 2 THEN '1948' ELSE '19481213' END", "'*F~'", NL,
    "CASE WHEN j % 11 = 4 THEN '' ELSE concat('REF*2U*', payer, '~', chr(10)) END",
    "'CLM*CLM'", "ks", "'*'", "charge", "'***11:B:1*Y*A*Y*Y~'", NL,
    "CASE WHEN j % 13 = 5 THEN '' ELSE concat('HI*ABK:', replace(dx1, '.', ''), '*ABF:', "
    "CASE WHEN j % 4 = 2 THEN dx2 ELSE replace(dx2, '.', '') END, "
    "CASE WHEN j % 7 = 3 THEN '**' ELSE '' END, '~', chr(10)) END",
    "'SV1*HC:'", "px1", "'*100*UN*1***1~'", NL,
    "CASE WHEN j % 4 = 1 THEN concat('SV1*', px2, '*50~', chr(10)) WHEN j % 4 = 3 THEN "
    "concat('SV1*HC:', px2, '*50~', chr(10)) ELSE '' END",
    "CASE WHEN j % 53 = 8 THEN concat('SV1~', chr(10)) ELSE '' END",
    "'SE*15*0001~'", NL,
)
HL7 = cat(
    "'MSH|^~'", "chr(92)", "'&|EPIC|MERCY|RCM|PLATFORM|20240215100000||'",
    pick("ADT^A08,ORM^O01,DFT^P03", "j"), "'|MSG'", "ks", "'|P|2.5'", "eol",
    "CASE WHEN j % 7 = 2 THEN concat('PID|1||OLD||NOBODY^ANY||19000101|M', eol) ELSE '' END",
    "'PID|1|| MRN-'", "ks", "'||'", "ln", "'^'", "fn", "'||'",
    "CASE WHEN j % 9 = 2 THEN '1942' ELSE '19420203' END", "'|F|||101 MAIN ST^^AUSTIN^TX'", "eol",
    "'PV1|1|O|CLINIC^^^MERCY||||'", "npi", "'^PROVIDER^TEST'", "eol", "'A|'", "eol",
    "CASE WHEN j % 11 = 4 THEN '' ELSE concat('IN1|1|PLAN01|', payer, '|Payer', eol) END",
    "CASE WHEN j % 13 = 5 THEN '' ELSE concat('DG1|1|I10|', dx1, "
    "CASE WHEN j % 2 = 0 THEN concat('^Diagnosis ', dx1, '^I10') ELSE '' END, eol) END",
    "CASE WHEN j % 6 = 1 THEN concat('DG1|2|I10|', dx2, eol) ELSE '' END",
    "CASE WHEN j % 17 = 5 THEN '' ELSE concat('PR1|1|CPT4|', px1, '^Procedure^C4|||20241106', eol) END",
)
EVENT_BODY = cat(
    "'{\"event\": \"'",
    pick("referral.created,prior_auth.submitted,claim.denied,eligibility.checked,note.uploaded,other.kind", "j"),
    "'\", \"event_id\": \"evt-'", "ks", "'\", \"patient\": {\"name\": \"'", "nm",
    "'\", \"dob\": \"1978-04-12\", \"mrn\": \"MRN-'", "ks", "'\"}, '",
    "CASE WHEN j % 11 = 4 THEN '' ELSE concat('\"payer\": {\"id\": \"', payer, '\", \"name\": \"', payer_name, '\"}, ') END",
    "'\"diagnosis_codes\": ['",
    "CASE WHEN j % 13 = 5 THEN '' ELSE concat('\"', dx1, '\", \"', dx2, '\"') END",
    "'], \"procedure_codes\": [\"'", "px1", "'\"], \"provider_npi\": \"'", "npi", "'\", \"claim_number\": \"CLM'", "ks",
    "'\", \"notes\": \"mail a'", "ks", "'@example.org\"'",
    "CASE WHEN j % 6 = 2 THEN concat(', \"denial\": {\"reason_code\": \"', carc, '\", \"appeal_by\": \"2024-09-30\"}') ELSE '' END",
    "CASE WHEN j % 6 = 1 THEN concat(', \"auth_number\": \"PA', ks, '\"') ELSE '' END",
    "'}'",
)
WEBHOOK = cat(
    "'{\"headers\": {'",
    "CASE WHEN j % 9 = 0 THEN '' ELSE '\"content-type\": \"application/json\", ' END",
    "'\"x-source-system\": \"partner-portal\"}, \"body\": \"'",
    "replace(body, '\"', concat(chr(92), '\"'))", "'\"}'",
)


def fax_blocks() -> str:
    first = {
        0: ["'EXPLANATION OF BENEFITS - CLAIM DENIED'", "concat('Patient: ', nm)", "'DOB: 1943-05-04'",
            "concat('MRN: MRN-', ks)", "concat('Payer: ', payer_name, ' (', payer, ')')",
            "concat('Provider NPI: ', npi)"],
        1: ["'PRIOR AUTHORIZATION REQUEST'", "concat('Patient: ', nm)", "concat('Member ID: M-', ks)",
            "concat('Payer: ', payer)", "concat('Provider NPI: ', npi)", "'medically necessary'"],
        2: ["'REFERRAL REQUEST'", "concat('Patient: ', nm)", "concat('MRN-', ks)",
            "concat('Provider NPI: ', npi)", "'Reason for referral: patient has persistent symptoms'",
            "concat('seen by payer ', payer, '. Payer ', payer)"],
        3: ["'PROGRESS NOTE'", "concat('Patient: ', nm)",
            "'Assessment and plan: continue current therapy'"],
        4: ["'ELIGIBILITY VERIFICATION'", "concat('Patient: ', nm)", "concat('MRN: MRN-', ks)",
            "'Coverage active. Copay $30.'"],
        5: ["'p.1'"],
        6: ["concat('Letter ', ks)", "concat('SSN 123-45-', lpad(cast(k % 10000 AS string), 4, '0'))",
            "'Card 4111 1111 1111 1111'", "'Write to billing@clinic.example'"],
    }
    second = {
        0: ["concat('ICD-10: ', dx1, ', ', dx2)", "concat('CPT: ', px1, ', ', px2)", "'Date of service: 2024-07-20'",
            "concat('Claim CLM', ks, ' denied ', upper(carc), ': reason CARC')", "concat('Billed amount: $', charge)",
            "'Appeal by 2024-12-01'"],
        1: ["concat('ICD-10: ', dx1)", "concat('CPT: ', px1)", "concat('Auth number: PA', ks)",
            "'Status: PENDING REVIEW'"],
        2: ["concat('Diagnosis ', dx1, '; ', dx2)", "concat('CPT ', px1)", "'Date of service: 2024-07-21'"],
        3: ["concat('ICD: ', dx2)", "'follow up in 4 weeks.'"],
        4: ["'Deductible remaining $450.'"],
        5: [],
        6: ["'thank you'"],
    }
    out = []
    for kind, texts in first.items():
        one = [block(1, t, i) for i, t in enumerate(texts)]
        two = [block(2, t, i + 3) for i, t in enumerate(second[kind])]
        sep = "', '"

        def joined(parts: list[str]) -> str:
            flat = []
            for i, p in enumerate(parts):
                flat += ([sep] if i else []) + [p]
            return cat(*flat)

        out.append(f"WHEN {kind} THEN CASE WHEN j % 3 = 0 THEN {joined(two + one)} ELSE {joined(one + two)} END")
    return "CASE j % 7 " + " ".join(out) + " END"


FAX = cat(
    "'{\"s3_key\": \"fax/inbox/2024/fax-'", "ks", "'.pdf\", \"content_type\": \"application/pdf\", \"blocks\": ['",
    "CASE WHEN j % 103 = 5 THEN '' ELSE blocks END", "']}'",
)


def codings(code: str) -> str:
    return f"concat('{{\"diagnosisCodeableConcept\": {{\"coding\": [{{\"system\": \"icd\", \"code\": \"', {code}, '\"}}]}}}}')"


def claim(first: str, second: str, px: str) -> str:
    return cat(
        "'{\"resource\": {\"resourceType\": \"Claim\", \"status\": \"active\", \"diagnosis\": ['",
        codings(first), "', '", codings(second),
        "'], \"item\": [{\"sequence\": 1, \"productOrService\": {\"coding\": [{\"system\": \"cpt\", \"code\": \"'", px,
        "'\"}, {\"system\": \"cpt\", \"code\": \"'", "px2", "'\"}]}}], \"total\": {\"value\": '", "charge",
        "', \"currency\": \"USD\"}}}'",
    )


FHIR = cat(
    "'{\"resourceType\": \"Bundle\", \"type\": \"collection\", \"entry\": ['",
    "CASE WHEN j % 13 = 2 THEN '' ELSE " + cat(
        "'{\"resource\": {\"resourceType\": \"Patient\", \"name\": [{\"family\": \"'", "split_part(nm, ' ', 2)",
        "'\", \"given\": [\"'", "split_part(nm, ' ', 1)", "CASE WHEN j % 7 = 1 THEN '\", \"Q' ELSE '' END",
        "'\"]}], \"birthDate\": \"1950-03-08\", \"identifier\": [{\"value\": \"MRN-'", "ks", "'\"}]}}, '",
        "CASE WHEN j % 11 = 3 THEN '' ELSE concat('{\"resource\": {\"resourceType\": \"Coverage\", \"payor\": "
        "[{\"identifier\": {\"value\": \"', payer, '\"}, \"display\": \"', payer_name, '\"}]}}, ') END",
        "CASE WHEN j % 17 = 4 THEN concat(" + claim("dx2", "dx2", "px2") + ", ', ') ELSE '' END",
        claim("dx1", "dx2", "px1"),
    ) + " END",
    "']}'",
)

RAW = f"""{BASE},
parts AS (
  SELECT *, CASE WHEN j % 6 = 0 THEN chr(13) ELSE chr(10) END AS eol,
    CASE WHEN src <> 'webhook' THEN '' WHEN j % 19 = 4 THEN ''
      WHEN j % 23 = 5 THEN concat('Ping from portal #', ks) ELSE
      CASE WHEN j % 17 = 3 THEN left(ev, 40) ELSE ev END END AS body,
    CASE WHEN src = 'fax' THEN {fax_blocks()} ELSE '' END AS blocks
  FROM (SELECT *, CASE WHEN src = 'webhook' THEN {EVENT_BODY} ELSE '' END AS ev FROM base) b
),
raw_files AS (
  SELECT k, src AS source, concat(src, '_', ks) AS file,
    CASE src
      WHEN 'edi837' THEN CASE WHEN j % 97 = 3 THEN '' ELSE {EDI} END
      WHEN 'hl7v2' THEN {HL7}
      WHEN 'webhook' THEN {WEBHOOK}
      WHEN 'fax' THEN CASE WHEN j % 101 = 7 THEN left({FAX}, 60) ELSE {FAX} END
      ELSE CASE WHEN j % 101 = 9 THEN left({FHIR}, 60) ELSE {FHIR} END
    END AS raw
  FROM parts
)"""

RAW_SQL = f"WITH {RAW} SELECT k, source, file, raw FROM raw_files"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    spread(orders, TASK_ROWS).createOrReplaceTempView("orders")
    return spark.sql(RAW_SQL)

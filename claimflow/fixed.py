"""Word lists, patterns, limits and tables that decide the results.

Everything here is data, stated plainly. The operators take these as defaults and accept
replacements (a DataFrame for the registries, a list for the rule catalogue).
"""

from __future__ import annotations

# -- Fixed values: validation limits and code formats
MIN_OCR_CONFIDENCE = 60.0
MIN_TEXT_LENGTH = 20
LOW_OCR_BLOCK = 85.0
ICD10_FORMAT = r"^[A-Z][0-9]{2}(\.[0-9A-Z]{1,4})?$"
CPT_FORMAT = r"^[0-9]{5}[A-Z0-9]?$"

# -- Fixed values: declared document types
WEBHOOK_EVENTS = {
    "referral.created": "referral",
    "prior_auth.submitted": "prior_auth",
    "claim.denied": "denial_eob",
    "eligibility.checked": "eligibility",
    "note.uploaded": "clinical_note",
}
HL7_MESSAGES = {"ORM": "referral", "DFT": "claim_837"}
SOURCE_HINT_CONFIDENCE = 0.99

# -- Fixed values: text rules, (document type, patterns, base confidence), in priority order
RULES = [
    ("denial_eob", [
        r"\bdenial\b", r"\bdenied\b", r"\bCO-\d+\b", r"\bPR-\d+\b", r"\bRARC\b", r"\bCARC\b",
        r"\bexplanation of benefits\b", r"\bEOB\b", r"\badjustment reason\b", r"\bremark code\b",
    ], 0.92),
    ("prior_auth", [
        r"\bprior auth", r"\bpre-auth", r"\bpre-certification\b", r"\bauthorization number\b",
        r"\bauth.*request\b", r"\bmedically necessary\b", r"\butilization review\b",
    ], 0.90),
    ("referral", [
        r"\breferral\b", r"\breferred to\b", r"\brefer.*patient\b", r"\boutpatient.*referral\b",
        r"\bPCP.*refer", r"\bprimary care.*refer",
    ], 0.88),
    ("claim_837", [
        r"\b837\b", r"\bclaim.*form\b", r"\bCMS-1500\b", r"\bUB-04\b", r"\bplace of service\b",
        r"\bbilling.*provider\b",
    ], 0.88),
    ("clinical_note", [
        r"\bSOAP note\b", r"\bdischarge summary\b", r"\bprogress note\b",
        r"\bassessment and plan\b", r"\bHPI\b", r"\bhistory of present illness\b",
    ], 0.85),
    ("eligibility", [
        r"\beligibility\b", r"\b271\b.*\bresponse\b", r"\b270\b.*\binquiry\b",
        r"\bbenefits\b.*\bverification\b", r"\bcoverage.*verification\b",
    ], 0.87),
]
RULES_THRESHOLD = 0.88
TEXT_MODEL_THRESHOLD = 0.72
TEXT_MODEL_FLOOR = 0.40
MODEL_EXCERPT = 800

# -- Fixed values: routing
QUEUES = {
    "prior_auth": "onecall-prior-auth-agent.fifo",
    "denial_eob": "onecall-denial-agent.fifo",
    "referral": "onecall-triage-agent",
    "claim_837": "onecall-claim-processor",
    "clinical_note": "onecall-clinical-enrichment",
    "eligibility": "onecall-eligibility-agent",
    "unknown": "onecall-human-review",
}
REVIEW_QUEUE = "onecall-human-review"
HIGH_PRIORITY = ["prior_auth", "denial_eob"]

# -- Fixed values: personal data patterns, applied in this order
PII = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
]

# -- Fixed values: free-text extraction, field -> pattern (first group is the value)
TEXT_SCALARS = [
    ("patient_name", r"Patient:?\s+([A-Z][a-z]+ [A-Z][a-z]+)"),
    ("patient_dob", r"DOB:?\s*(\d{4}-\d{2}-\d{2})"),
    ("patient_id", r"\b(MRN-\d+)"),
    ("member_id", r"Member ID:?\s*([A-Z0-9-]+)"),
    ("provider_npi", r"Provider NPI:?\s*(\d{10})"),
    ("claim_number", r"Claim\s+(CLM\d+)"),
    ("service_date", r"Date of service:?\s*(\d{4}-\d{2}-\d{2})"),
    ("total_charge", r"Billed amount:?\s*\$?([\d.]+)"),
    ("auth_number", r"Auth(?:orization)?(?: number)?:?\s*((?:PA|AUTH-)[A-Z0-9-]+)"),
    ("auth_status", r"Status:?\s*([A-Za-z ]+?)(?:\.|\n|$)"),
    ("appeal_deadline", r"Appeal by\s*(\d{4}-\d{2}-\d{2})"),
]
PAYER_LINE = r"Payer:?\s*([^\n]+)"
PAYER_PARENS = r"\(([A-Z0-9-]+)\)"
PAYER_LEADING = r"^([A-Z]+-[A-Z0-9]+)"
PAYER_ANYWHERE = r"\bPayer\s+([A-Z]+-[A-Z0-9]+)"
PAYER_TAIL = r"\s*\(.*"
DX_ZONE = r"(?:ICD-?10|Diagnosis|ICD)[:\s]+([^\n]*)"
PX_ZONE = r"CPT[:\s]+([^\n]*)"
DX_CODE = r"\b[A-Z]\d{2}\.?[0-9A-Z]{0,4}\b"
PX_CODE = r"\b\d{5}\b"
CARC_CODE = r"\b(?:CO|PR|OA|PI)-\d+\b"

# -- Fixed values: confidence of each built-in extractor
JSON_CONFIDENCE = 0.97
HL7_CONFIDENCE = 0.93
EDI_CONFIDENCE = 0.95
TEXT_CONFIDENCE = 0.86
RULES_CONFIDENCE = 0.70
LOW_FIELD = 0.60
REVIEW_THRESHOLD = 0.55
OCR_PENALTY_BELOW = 85.0
OCR_PENALTY_WEIGHT = 0.25
MAX_PROMPT_CHARS = 6000

# -- Fixed values: default registries
NPI_REGISTRY = [
    ("1234567890", "Dr. Jane Smith", "207Q00000X", "TX"),
    ("9876543210", "Dr. Robert Jones", "208D00000X", "CA"),
]
ICD10_REFERENCE = [
    "M54.5", "M54.50", "J45.901", "J18.9", "Z00.00", "Z87.891", "E11.9", "E11.65", "I10",
    "J44.1", "M51.16", "N18.3",
]
CPT_REFERENCE = [
    "99213", "99214", "99215", "99233", "73721", "27447", "22612", "94640", "94010", "90837",
    "99243",
]

# -- Fixed values: model table, tier -> (model id, max tokens, price per 1k tokens)
MODELS = {
    "local_slm": ("llama3.2", 2048, 0.0),
    "fast": ("claude-haiku-4-5-20251001", 1024, 0.0003),
    "standard": ("claude-sonnet-4-20250514", 4096, 0.003),
    "premium": ("claude-opus-4-6", 8192, 0.015),
}
PRICES = {
    "claude-haiku-4-5-20251001": 0.0003,
    "claude-sonnet-4-20250514": 0.003,
    "claude-opus-4-6": 0.015,
    "gpt-4o": 0.005,
    "gpt-4o-mini": 0.0002,
    "llama3.2": 0.0,
    "mistral": 0.0,
}
DEFAULT_PRICE = 0.003
PREMIUM_ABOVE = 5000
SHORT_UP_TO = 1000
STANDARD_TASKS = ["extraction", "classification_llm"]
PROMPT_MODEL = "claude-sonnet-4-20250514"
PROMPT_MAX_TOKENS = 2048

# -- Fixed values: guardrails
MIN_OUTPUT = 5
MAX_OUTPUT = 50_000
REQUIRED_KEYS = ["document_id", "document_type", "mean_confidence"]

# -- Fixed values: decisions
PRIOR_AUTH_REQUIRED = [
    "patient_name", "member_id", "provider_npi", "diagnosis_codes", "procedure_codes", "payer_id",
]
PRIOR_AUTH_MAX_MISSING = 2
PRIOR_AUTH_GATE = 0.80
OVERTURNABLE = ["CO-4", "CO-11", "CO-50", "CO-97", "PR-96"]
MEDICAL_NECESSITY = ["CO-50", "CO-97"]
DENIAL_GATE = 0.65
URGENT_DX = ["I21.9", "I63.9", "J96.0", "N17.9", "K92.1"]
REFERRAL_GATE = 0.60
DEFAULT_PROVIDER = ("1234567890", "City Orthopedics", "3 days")

# -- Fixed values: evaluation gates
F1_GATE = 0.80
EXACT_GATE = 0.90

# -- Fixed values: classification prompt
CLASSIFY_SYSTEM = """\
You are a healthcare RCM document classifier.
Classify into exactly one of:
  referral, prior_auth, denial_eob, claim_837, clinical_note, eligibility, unknown

Respond ONLY with valid JSON (no preamble):
{"type": "<type>", "confidence": <0.0-1.0>, "reasoning": "<one sentence>"}
"""

# -- Fixed values: extraction prompts
PROMPT_VERSION = "v1.2.0"
PROMPT_BASE = """\
You are a healthcare RCM data extraction specialist (prompt v1.2.0).
Extract structured clinical and billing data from the document.
Return ONLY valid JSON. No preamble. Use null for missing fields. Confidence 0.0–1.0.
Each field: {"value": <value>, "confidence": <0.0-1.0>, "source": "llm"}
"""
PROMPT_BODIES = {
    "denial_eob": """
Extract from DENIAL / EOB:
{"patient_name": field|null, "member_id": field|null, "claim_number": field|null,
 "payer_id": field|null, "payer_name": field|null,
 "diagnosis_codes": [field,...], "procedure_codes": [field,...],
 "denial_reason_codes": [field,...], "denial_date": field|null,
 "appeal_deadline": field|null, "total_charge": field|null, "service_date": field|null}
Include CARC (CO-XX, PR-XX) and RARC (N-XX, M-XX) in denial_reason_codes.
""",
    "prior_auth": """
Extract from PRIOR AUTH:
{"patient_name": field|null, "patient_dob": field|null, "member_id": field|null,
 "provider_npi": field|null, "diagnosis_codes": [field,...], "procedure_codes": [field,...],
 "payer_id": field|null, "payer_name": field|null,
 "auth_number": field|null, "auth_status": field|null, "service_date": field|null}
""",
    "referral": """
Extract from REFERRAL:
{"patient_name": field|null, "patient_dob": field|null, "patient_id": field|null,
 "provider_name": field|null, "provider_npi": field|null,
 "diagnosis_codes": [field,...], "procedure_codes": [field,...],
 "service_date": field|null, "payer_id": field|null, "payer_name": field|null}
""",
    "claim_837": """
Extract from 837 CLAIM:
{"patient_name": field|null, "patient_id": field|null, "provider_name": field|null,
 "provider_npi": field|null, "payer_id": field|null,
 "diagnosis_codes": [field,...], "procedure_codes": [field,...],
 "service_date": field|null, "place_of_service": field|null,
 "claim_number": field|null, "total_charge": field|null}
""",
}
PROMPT_DEFAULT_BODY = """
Extract all available clinical and billing fields:
{"patient_name": field|null, "patient_dob": field|null, "patient_id": field|null,
 "provider_name": field|null, "diagnosis_codes": [field,...],
 "procedure_codes": [field,...], "payer_id": field|null, "service_date": field|null}
"""
USER_TEMPLATE = "DOCUMENT:\n{text}"

# -- Fixed values: labelled seed corpus of the text model
SEED_CORPUS = [
    ("Claim denied. CO-4: procedure inconsistent with modifier. RARC N56. EOB enclosed.", "denial_eob"),
    ("Explanation of Benefits. CO-11 diagnosis inconsistent with procedure. PR-1 deductible $350.", "denial_eob"),
    ("Service denied as not medically necessary. CO-50. Appeal within 90 days.", "denial_eob"),
    ("EOB — claim adjustment. CO-45 contractual adjustment $120. Remark MA01.", "denial_eob"),
    ("Your claim for CPT 99215 has been denied. CO-97 bundling applies.", "denial_eob"),
    ("Prior authorization request for lumbar spinal fusion CPT 22612. Diagnosis M51.16. Medically necessary.", "prior_auth"),
    ("Pre-certification request for Humira 40mg biweekly. Refractory rheumatoid arthritis.", "prior_auth"),
    ("Authorization request for inpatient psychiatric admission. Patient is danger to self.", "prior_auth"),
    ("Utilization review request. MRI lumbar spine without contrast. Radiculopathy.", "prior_auth"),
    ("Pre-auth for bariatric surgery. BMI 42. Six-month supervised weight loss complete.", "prior_auth"),
    ("I am referring this patient to orthopedic surgery for chronic low back pain.", "referral"),
    ("Referral to cardiology for evaluation of chest pain and dyspnea on exertion.", "referral"),
    ("Patient referred to physical therapy for post-surgical rehabilitation. 12 visits approved.", "referral"),
    ("Please see this patient for neurology consultation. Focal seizure episodes.", "referral"),
    ("Outpatient referral to wound care clinic for non-healing diabetic foot ulcer.", "referral"),
    ("837P Professional Claim. NPI 1234567890. CPT 99213. Diagnosis M54.5. Place of service 11.", "claim_837"),
    ("CMS-1500 claim. Patient Johnson Robert. Service dates 02/01/2024. CPT 99233. ICD J18.9.", "claim_837"),
    ("837I Institutional claim. UB-04 form. Revenue code 0450. DRG 470. Admission 03/10/2024.", "claim_837"),
    ("SOAP Note. Chief Complaint: Low back pain. HPI: 45yo male acute onset LBP. Assessment: lumbar strain.", "clinical_note"),
    ("Discharge Summary. Patient admitted for COPD exacerbation. Treated with IV steroids.", "clinical_note"),
    ("Progress Note. Follow-up Type 2 DM. HbA1c 8.1%. Continue metformin 1000mg BID.", "clinical_note"),
    ("History of present illness: patient presents with three weeks of bilateral knee pain.", "clinical_note"),
    ("270 Eligibility Response. Member XY123456. Plan Blue Choice PPO. Deductible $1500 met $450.", "eligibility"),
    ("Benefits Verification. Coverage confirmed outpatient services. Co-pay $35. OOP max $6000.", "eligibility"),
    ("271 Eligibility Response. Subscriber Johnson Robert DOB 1965-08-22. Active coverage confirmed.", "eligibility"),
]

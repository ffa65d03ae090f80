"""Fixed values of the audit, and the small dimension DataFrames made from them.

Everything in this module is a value that results depend on: patterns, keyword
lists, confidences, the parameter registry, the rule matrix, section titles.
They are written as plain text in their natural order.  Patterns use the Python
``re`` dialect; ``functions.regex`` turns them into Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.functions.text import quoted

# --------------------------------------------------------------------------
# Detectors, in priority order
# (type, pattern, ignore case, confidence, masked)
# --------------------------------------------------------------------------
DETECTORS = [
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", True, 0.97, False),
    ("AADHAAR_MASKED", r"\b[Xx*]{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", False, 0.90, True),
    ("AADHAAR_UNMASKED", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", False, 0.95, False),
    ("CREDIT_DEBIT_CARD", r"\b(?:\d{4}[\s\-]){3}\d{4}\b", False, 0.93, False),
    ("MASKED_CARD", r"\b[Xx*]{4}[\s\-][Xx*]{4}[\s\-][Xx*]{4}[\s\-]\d{4}\b", False, 0.90, True),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", True, 0.96, False),
    ("PASSPORT", r"\b[A-PR-WY][1-9]\d\s?\d{4}[1-9]\b", True, 0.88, False),
    ("VOTER_ID", r"\b[A-Z]{3}\d{7}\b", True, 0.85, False),
    ("DRIVING_LICENCE",
     r"\b[A-Z]{2}[\s\-]?\d{2}[\s\-]?\d{4}[\s\-]?\d{7}\b|\b[A-Z]{2}\d{13}\b", True, 0.82, False),
    ("UPI_HANDLE",
     r"\b[\w.\-]{2,256}@(?:okaxis|okicici|oksbi|okhdfc|ybl|ibl|axl|upi|paytm|apl|airtel|jio|fbl"
     r"|rbl|gpay|phonepe|razorpay|[a-z]{2,20})\b", True, 0.90, False),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", False, 0.92, False),
    ("PHONE_IN", r"(?<!\d)(\+91[\s\-]?)?[6-9]\d{9}(?!\d)", False, 0.88, False),
    ("IP_ADDRESS",
     r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
     False, 0.94, False),
    ("DATE_OF_BIRTH",
     r"\b(?:\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})\b",
     False, 0.78, False),
    ("BANK_ACCOUNT", r"(?<![/\-\d])\b\d{9,18}\b(?![/\-\d])", False, 0.72, False),
    ("_KW_CCTV", r"\b(?:cctv|surveillance|security\s*cam(?:era)?|video\s*recording)\b",
     True, 0.68, False),
    ("_KW_VOICE", r"\b(?:voice\s*recording|audio\s*clip|call\s*recording)\b", True, 0.68, False),
    ("_KW_PASSWORD", r"\b(?:password|passwd|pwd|passphrase)\b", True, 0.70, False),
    ("_KW_COOKIE", r"\b(?:cookie|session[\s_-]?id|auth[\s_-]?token|bearer)\b", True, 0.65, False),
    ("_KW_PHOTOGRAPH", r"\b(?:photograph|photo|selfie|portrait|face\s*image)\b", True, 0.65, False),
    ("_KW_SIGNATURE", r"\b(?:signature|sign|signed|countersign)\b", True, 0.62, False),
]
DETECTOR_TYPES = [d[0] for d in DETECTORS]
# A type whose spans never block later detectors.
NON_CLAIMING_TYPE = "AADHAAR_UNMASKED"

# --------------------------------------------------------------------------
# Contextual extraction
# --------------------------------------------------------------------------
BALANCE_PATTERN = (
    r"(?:account\s+balance|available\s+balance|ledger\s+balance|total\s+balance|balance|bal"
    r"|available|ledger|lien|total)\s*[:\-\.]?\s*(?:rs\.?|inr|₹)?\s*([\d,]+\.\d{2})"
)
CUSTOMER_ID_PATTERN = r"(?:customer id|cust id|cif|crn)\s*[:\-\.]?\s*([A-Z0-9]{5,15})"
UPI_PATH_PATTERN = r"(?:upi|neft|rtgs|imps)/(?:[a-zA-Z]+)/(\d{10,20})"
LABELLED_REF_PATTERN = r"(?:txn id|ref no|reference|utr)\s*[:\-\.]?\s*([A-Z0-9]{8,20})"
DATED_LINE_PATTERN = (
    r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}"
    r"|\d{1,2}[\-/\.](?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\-/\.]\d{2,4}"
)
BANK_CODES = (
    r"(?:SIBL|YESB|SBIN|UBIN|HDFC|ICIC|UTIB|CNRB|PUNB|BARB|KKBK|IDIB|IOBA|FDRL|BKID|MAHB|INDB|PYTM)"
)
UPI_CHAIN_PATTERN = (
    r"\b(?:UPI|IMPS|NEFT|RTGS)[/\-\s]+" + BANK_CODES + r"?[/\-\s]*([A-Z0-9]{8,22})\b"
)
LINE_REF_PATTERN = (
    r"\b(?:txn(?:\s*id)?|transaction\s*id|ref(?:erence)?(?:\s*no)?|utr|rrn)\s*[:#/\-\s]+"
    r"([A-Z0-9]{8,24})\b"
)
LONG_NUMBER_PATTERN = r"(?<!\d)(\d{10,20})(?!\d)"
DATE_AMOUNT_ROW_PATTERN = (
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b.*"
    r"\b(?:debit|credit|dr|cr|upi|neft|imps|rtgs|transfer|payment)\b"
)
CAPITAL_NAME_PATTERN = r"\b[A-Z][A-Z .'-]*(?:\s+[A-Z][A-Z .'-]*){1,4}\b"
AMOUNT_PATTERN = r"(?:rs\.?|inr|₹)\s*([0-9][0-9,]*\.\d{2}|[0-9][0-9,]*)"

HISTORY_DOCUMENT_TYPES = ["Bank Statement", "Passbook Screen", "Transaction Receipt"]
NAME_STOP_PHRASES = [
    "AVAILABLE BALANCE", "ACCOUNT NUMBER", "TRANSACTION HISTORY", "CREDIT CARD", "DEBIT CARD",
    "SOUTH INDIAN BANK", "SAVINGS GENERAL", "BLOCK CARD", "MANAGE CARD", "SET PIN", "RESET PIN",
    "CVV", "EXPIRES ON", "RUPAY", "VISA", "MASTERCARD", "APPLY NEW CARD", "APPLY NOW", "PAY NOW",
    "SEND MONEY", "REQUEST MONEY", "ADD PAYEE", "VIEW STATEMENT", "DOWNLOAD PDF", "SHARE RECEIPT",
    "CONFIRM PAYMENT", "PROCEED TO PAY", "CLICK HERE", "KNOW MORE", "LEARN MORE",
    "ADD BENEFICIARY", "NEW CARD", "GET CARD", "NFC",
]
NAME_FORBIDDEN_TOKENS = [
    "NFC", "VISA", "MASTERCARD", "RUPAY", "CARD", "CVV", "EXPIRES", "BANK", "SAVINGS", "GENERAL",
    "BALANCE",
]
TRANSACTION_KEYWORDS = [
    "upi", "txn", "transaction", "ref", "reference", "utr", "transfer", "payment", "sibl", "yesb",
    "sbin", "ubin", "neft", "rtgs", "imps", "debit", "credit", "narration",
]
AADHAAR_KEYWORDS = [
    "aadhaar", "aadhar", "uid", "uidai", "vid", "ekyc", "kyc", "identity proof", "id proof",
]
BANKING_KEYWORDS = [
    "upi", "txn", "transaction", "ref", "reference", "utr", "transfer", "payment", "sibl", "yesb",
    "sbin", "ubin", "neft", "rtgs", "imps", "debit", "credit", "balance", "narration",
]
ACCOUNT_KEYWORDS = [
    "account", "acct", "a/c", "account no", "account number", "sb ", "savings", "current",
]

# The published Verhoeff multiplication and permutation tables.
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]

# --------------------------------------------------------------------------
# Label aliases of the layout stage
# --------------------------------------------------------------------------
LABEL_ALIASES = {
    "CUSTOMER_ID": ["customerid", "custid", "cif", "cifnumber", "crn", "customeridentification"],
    "BANK_ACCOUNT": ["accountnumber", "accountno", "acctnumber", "acctno", "acnumber", "acno"],
    "IFSC": ["ifsccode", "ifsc"],
    "BRANCH_NAME": ["branchname", "branch"],
    "ACCOUNT_BALANCE": ["accountbalance", "availablebalance", "ledgerbalance", "totalbalance",
                        "balance"],
    "ACCOUNT_HOLDER_NAME": ["accountholdername", "holdername", "accountname", "customername"],
}
ALIAS_TO_TYPE = {alias: kind for kind, names in LABEL_ALIASES.items() for alias in names}
SUMMARY_STOP_LABELS = ["ministatement", "statement", "transactionhistory"]

# --------------------------------------------------------------------------
# Why a match was made, per detector and per kind of contextual rule
DETECTOR_REASON = "Matched standard {} pattern"
BALANCE_REASON = "Detected near balance keywords (e.g. 'Available Balance')"
CUSTOMER_REASON = "Detected near Customer ID/CIF labels and validated as an identifier"
UPI_PATH_REASON = "Detected inside UPI/Bank transaction structure"
LABELLED_REASON = "Detected near Txn ID/Ref No labels"
HISTORY_REASON = "Detected repeated date/amount tabular structure"
NAME_REASON = "Line segment matches ALL CAPS name heuristics."
AMOUNT_REASON = "Detected standalone financial transaction amount"
LINE_REF_REASON = "Detected banking transaction reference '{}' with context keywords [{}] in OCR row: {}"
ROW_KEYWORD = "transaction row"

# How a value stands to its label, and what its form says
SAME_BLOCK_RELATION = "same OCR block as label"
BESIDE_RELATION = "same-row value to the right of label"
BELOW_RELATION = "nearest vertically aligned value below label"
FAR_RELATION = "not spatially aligned with label"
INFERRED_RELATION = "found alphabetic name positioned below the account row"
INFERRED_LABEL = "Account Holder Name"
INFERRED_MAPPING = "Inferred holder name from alphabetic value immediately below Account Number label"
ASSOCIATION_REASON = "Layout label-value association: {} -> {} ({})"
INFERENCE_REASON = "Layout inference: {} -> {} ({})"
NUMERIC_CUSTOMER_REASON = "numeric customer identifier candidate"
# type, when it fits, when it does not
VALUE_REASONS = [
    ("CUSTOMER_ID", "alphanumeric customer identifier with digits", "customer id validation failed"),
    ("BANK_ACCOUNT", "long numeric account number outside transaction context", "account number validation failed"),
    ("IFSC", "valid IFSC format", "IFSC validation failed"),
    ("ACCOUNT_BALANCE", "currency amount near balance label", "balance amount validation failed"),
    ("ACCOUNT_HOLDER_NAME", "multi-word alphabetic account holder name", "account holder name validation failed"),
    ("BRANCH_NAME", "alphabetic branch/location text", "branch name validation failed"),
]
NAME_WORD_REASON = "name contains invalid/banking keywords"
NAME_MASK_REASON = "name consists of masking characters"

# Entity catalogue (type, category, risk, display name)
# --------------------------------------------------------------------------
ENTITY_CATALOGUE = [
    ("PAN", "KYC Documents", "High", "PAN Details"),
    ("AADHAAR_UNMASKED", "KYC Documents", "Critical", "Aadhaar Details (Unmasked)"),
    ("AADHAAR_MASKED", "KYC Documents", "Medium", "Aadhaar Details (Masked)"),
    ("PASSPORT", "KYC Documents", "High", "Passport Number"),
    ("VOTER_ID", "KYC Documents", "Medium", "Voter ID"),
    ("DRIVING_LICENCE", "KYC Documents", "Medium", "Driving Licence"),
    ("EMAIL", "Identity Data", "Medium", "Personal Email ID"),
    ("PHONE_IN", "Identity Data", "High", "Personal Phone Number"),
    ("DATE_OF_BIRTH", "Identity Data", "Medium", "Date of Birth"),
    ("_KW_PHOTOGRAPH", "Identity Data", "Low", "Photograph Reference"),
    ("_KW_SIGNATURE", "Identity Data", "Low", "Signature Reference"),
    ("CREDIT_DEBIT_CARD", "Financial Data", "Critical", "Credit/Debit Card Details"),
    ("MASKED_CARD", "Financial Data", "Medium", "Masked Card Number"),
    ("BANK_ACCOUNT", "Financial Data", "High", "Bank Account Number"),
    ("IFSC", "Financial Data", "High", "IFSC Code"),
    ("UPI_HANDLE", "Financial Data", "High", "UPI Handle"),
    ("IP_ADDRESS", "Online Identifiers", "Medium", "IP Address"),
    ("_KW_PASSWORD", "Online Identifiers", "Critical", "Password Reference"),
    ("_KW_COOKIE", "Online Identifiers", "Medium", "Cookie / Session Reference"),
    ("_KW_CCTV", "Other Information", "Low", "CCTV / Surveillance Reference"),
    ("_KW_VOICE", "Other Information", "Low", "Voice Recording Reference"),
    ("ACCOUNT_BALANCE", "Financial Data", "High", "Account Balance"),
    ("CUSTOMER_ID", "Identity Data", "High", "Customer ID"),
    ("ACCOUNT_HOLDER_NAME", "Identity Data", "High", "Account Holder Name"),
    ("BRANCH_NAME", "Financial Data", "High", "Branch Name"),
    ("TRANSACTION_REFERENCE", "Financial Data", "None", "Transaction Reference"),
    ("TRANSACTION_HISTORY", "Financial Data", "High", "Transaction History"),
    ("TRANSACTION_AMOUNT", "Financial Data", "High", "Transaction Amount"),
]
# The rules-only catalogue does not know this type.
RULES_ONLY_UNKNOWN_TYPE = "TRANSACTION_AMOUNT"
DEFAULT_CATEGORY = "Other Information"
DEFAULT_RISK = "Low"
MASKED_TYPES = ["AADHAAR_MASKED", "MASKED_CARD"]

# Names an external decision may use for a type.
DECISION_TYPE_ALIASES = {
    "AADHAAR": "AADHAAR_UNMASKED",
    "AADHAAR_NUMBER": "AADHAAR_UNMASKED",
    "BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT",
    "ACCOUNT_NUMBER": "BANK_ACCOUNT",
    "IFSC_CODE": "IFSC",
    "CUSTOMERID": "CUSTOMER_ID",
    "CUSTOMER_ID": "CUSTOMER_ID",
    "NAME": "ACCOUNT_HOLDER_NAME",
    "ACCOUNT_HOLDER_NAME": "ACCOUNT_HOLDER_NAME",
    "BRANCH": "BRANCH_NAME",
    "BRANCH_NAME": "BRANCH_NAME",
    "TRANSACTION_ID": "TRANSACTION_REFERENCE",
    "TRANSACTION_REFERENCE": "TRANSACTION_REFERENCE",
    "TRANSACTION_HISTORY": "TRANSACTION_HISTORY",
    "ACCOUNT_BALANCE": "ACCOUNT_BALANCE",
}
IGNORED_DECISIONS = ["IGNORE", "NOT_PII", "UNKNOWN"]
DECISION_TYPES = [
    "PAN", "AADHAAR_UNMASKED", "AADHAAR_MASKED", "EMAIL", "PHONE_IN", "DATE_OF_BIRTH",
    "CREDIT_DEBIT_CARD", "MASKED_CARD", "BANK_ACCOUNT", "IFSC", "UPI_HANDLE", "ACCOUNT_BALANCE",
    "CUSTOMER_ID", "ACCOUNT_HOLDER_NAME", "BRANCH_NAME", "TRANSACTION_REFERENCE",
    "TRANSACTION_HISTORY", "TRANSACTION_AMOUNT", "IGNORE",
]

# --------------------------------------------------------------------------
# Document types, first match wins
# --------------------------------------------------------------------------
RECEIPT_WORDS = [
    "transaction successful", "payment details", "txn id", "txn no", "transaction id", "paid to",
    "received from", "payment successful", "ref no",
]
STATEMENT_WORDS = [
    "statement of account", "account statement", "opening balance", "closing balance", "narration",
    "withdrawal", "deposit",
]
DOCUMENT_WORDS = [
    ("Passbook Screen", ["passbook", "m-passbook"]),
    ("Account Summary", ["account summary", "available balance", "ledger balance", "lien amount",
                         "total balance"]),
    ("KYC Form", ["kyc", "customer information file", "know your customer", "nominee details",
                  "fatca", "address proof"]),
    ("Profile Screen", ["profile details", "personal details", "contact information",
                        "edit profile", "my profile"]),
    ("Loan/Credit Screen", ["loan account", "credit limit", "emi amount", "outstanding balance",
                            "repayment", "loan summary"]),
    ("Insurance Document", ["insurance policy", "premium amount", "policy number", "sum assured",
                            "coverage details"]),
]
GENERIC_BANK_WORDS = ["bank", "branch", "ifsc", "account number", "beneficiary"]

# --------------------------------------------------------------------------
# Screen types, in list order (id, keywords)
# --------------------------------------------------------------------------
SCREEN_SIGNALS = [
    ("SCR-09", ["video kyc", "video feed", "face capture", "video verification"]),
    ("SCR-13", ["login", "sign in", "signin", "otp", "password", "authenticate", "enter pin"]),
    ("SCR-12", ["stack trace", "traceback", "error code", "debug", "internal server",
                "exception"]),
    ("SCR-10", ["consent", "i agree", "accept", "decline", "terms and conditions",
                "privacy policy", "withdraw consent", "permission"]),
    ("SCR-11", ["offer", "promotional", "partner", "sponsored", "advertisement", "apply now",
                "exclusive deal", "cashback offer"]),
    ("SCR-06", ["recharge", "mobile recharge", "prepaid", "operator", "talktime"]),
    ("SCR-04", ["card number", "card no", "cvv", "expiry", "debit card", "credit card",
                "card details", "card ending"]),
    ("SCR-01", ["kyc", "know your customer", "verify identity", "aadhaar", "pan verification",
                "address proof", "identity verification", "onboarding", "e-kyc", "ckyc",
                "fatca"]),
    ("SCR-08", ["loan", "emi", "credit limit", "outstanding", "repayment", "loan summary",
                "credit application", "pre-approved"]),
    ("SCR-05", ["fund transfer", "neft", "rtgs", "imps", "beneficiary", "ifsc", "transfer to",
                "send money", "pay to", "upi transfer"]),
    ("SCR-03", ["transaction history", "mini statement", "passbook", "recent transactions",
                "statement of account", "account statement", "narration", "opening balance",
                "closing balance", "dr", "cr", "withdrawal", "deposit", "debit", "credit"]),
    ("SCR-07", ["profile", "personal details", "contact information", "edit profile",
                "my profile", "settings", "preferences", "update details"]),
    ("SCR-02", ["account summary", "available balance", "balance", "account no", "dashboard",
                "total balance", "savings account", "current account", "ledger balance"]),
]
FALLBACK_SCREEN = "SCR-02"
SCREEN_NAMES = [
    ("SCR-01", "KYC / Onboarding", "KYC Form"),
    ("SCR-02", "Account Summary / Dashboard", "Account Summary"),
    ("SCR-03", "Transaction History", "Bank Statement"),
    ("SCR-04", "Debit/Credit Card Info", "Generic Banking Screen"),
    ("SCR-05", "Fund Transfer / Payment", "Transaction Receipt"),
    ("SCR-06", "Mobile Recharge", "Generic Banking Screen"),
    ("SCR-07", "Profile / Settings", "Profile Screen"),
    ("SCR-08", "Loan / Credit Application", "Loan/Credit Screen"),
    ("SCR-09", "Video KYC", "KYC Form"),
    ("SCR-10", "Notification / Consent Banner", "Generic Banking Screen"),
    ("SCR-11", "Third-Party Offer / Ad", "Generic Banking Screen"),
    ("SCR-12", "Error / Debug Screen", "Unknown/Other"),
    ("SCR-13", "Login / Auth", "Generic Banking Screen"),
]

# --------------------------------------------------------------------------
# The fifty data parameters, what entities and text imply
# --------------------------------------------------------------------------
PARAMETERS = [
    ("KYC-01", "PAN Details", "KYC Documents"),
    ("KYC-02", "Aadhaar Details", "KYC Documents"),
    ("KYC-03", "Passport Details", "KYC Documents"),
    ("KYC-04", "Voter ID", "KYC Documents"),
    ("KYC-05", "Driving Licence", "KYC Documents"),
    ("ID-01", "Full Name", "Identity Data"),
    ("ID-02", "Customer ID", "Identity Data"),
    ("ID-03", "Photograph", "Identity Data"),
    ("ID-04", "Date of Birth", "Identity Data"),
    ("ID-05", "Gender", "Identity Data"),
    ("ID-06", "Location / Geo", "Identity Data"),
    ("ID-07", "Residential Address", "Identity Data"),
    ("ID-08", "Nationality", "Identity Data"),
    ("ID-09", "Spouse Name", "Identity Data"),
    ("ID-10", "Dependent Details", "Identity Data"),
    ("ID-11", "Insurance Details", "Identity Data"),
    ("ID-12", "Certificate", "Identity Data"),
    ("ID-13", "Personal Email ID", "Identity Data"),
    ("ID-14", "Personal Phone Number", "Identity Data"),
    ("ID-15", "Signature", "Identity Data"),
    ("ID-16", "Utility Bills", "Identity Data"),
    ("ID-17", "Religion", "Identity Data"),
    ("ID-18", "Reservation Category", "Identity Data"),
    ("ID-19", "Ration Number", "Identity Data"),
    ("ID-20", "Caste Certificate", "Identity Data"),
    ("FIN-01", "Bank Account Number", "Financial Data"),
    ("FIN-02", "Debit Card Details", "Financial Data"),
    ("FIN-03", "Credit Card Details", "Financial Data"),
    ("FIN-04", "Credit Score", "Financial Data"),
    ("FIN-05", "Bank Statements", "Financial Data"),
    ("FIN-06", "UPI Handle", "Financial Data"),
    ("FIN-07", "Account Balance", "Financial Data"),
    ("FIN-08", "Transaction History", "Financial Data"),
    ("FIN-09", "Income Proof", "Financial Data"),
    ("FIN-10", "Tax Returns", "Financial Data"),
    ("FIN-11", "CTC Data", "Financial Data"),
    ("BIO-01", "Fingerprints", "Biometric Data"),
    ("BIO-02", "Voice Patterns", "Biometric Data"),
    ("ONL-01", "Username", "Online Identifiers"),
    ("ONL-02", "Password", "Online Identifiers"),
    ("ONL-03", "IP Address", "Online Identifiers"),
    ("ONL-04", "Cookie / Session", "Online Identifiers"),
    ("CHD-01", "Child Name", "Children Data"),
    ("CHD-02", "Child DOB", "Children Data"),
    ("CHD-03", "Guardian Name", "Children Data"),
    ("CHD-04", "Disability Status", "Children Data"),
    ("CHD-05", "Disability Certificate", "Children Data"),
    ("OTH-01", "Voice Recording", "Other Sensitive"),
    ("OTH-02", "Video Recording", "Other Sensitive"),
    ("OTH-03", "CCTV Footage", "Other Sensitive"),
]
ENTITY_PARAMETERS = [
    ("PAN", ["KYC-01"]),
    ("AADHAAR_UNMASKED", ["KYC-02"]),
    ("AADHAAR_MASKED", ["KYC-02"]),
    ("ACCOUNT_HOLDER_NAME", ["ID-01"]),
    ("CUSTOMER_ID", ["ID-02"]),
    ("DATE_OF_BIRTH", ["ID-04"]),
    ("EMAIL", ["ID-13"]),
    ("PHONE_IN", ["ID-14"]),
    ("BANK_ACCOUNT", ["FIN-01"]),
    ("CREDIT_DEBIT_CARD", ["FIN-02", "FIN-03"]),
    ("MASKED_CARD", ["FIN-02", "FIN-03"]),
    ("UPI_HANDLE", ["FIN-06"]),
    ("ACCOUNT_BALANCE", ["FIN-07"]),
    ("TRANSACTION_HISTORY", ["FIN-08"]),
    ("TRANSACTION_REFERENCE", ["FIN-08"]),
    ("TRANSACTION_AMOUNT", ["FIN-08"]),
    ("IFSC", ["FIN-01"]),
    ("_KW_PASSWORD", ["ONL-02"]),
]
# (parameter, pattern on the lower-cased text, words of which every match contains one)
TEXT_SIGNALS = [
    ("KYC-03", r"\bpassport\b", ["passport"]),
    ("KYC-04", r"\bvoter\s*id\b", ["voter"]),
    ("KYC-04", r"\bepic\b", ["epic"]),
    ("KYC-05", r"\bdriving\s*licen[cs]e\b", ["driving"]),
    ("ID-03", r"\bphoto(?:graph)?\b", ["photo"]),
    ("ID-05", r"\bgender\b", ["gender"]),
    ("ID-06", r"\blocation\b", ["location"]),
    ("ID-07", r"\b(?:address|residence)\b", ["address", "residence"]),
    ("ID-08", r"\bnationality\b", ["nationality"]),
    ("ID-09", r"\bspouse\b", ["spouse"]),
    ("ID-09", r"\bjoint\s*holder\b", ["joint"]),
    ("ID-10", r"\b(?:dependent|nominee)\b", ["dependent", "nominee"]),
    ("ID-11", r"\binsurance\b", ["insurance"]),
    ("ID-15", r"\bsignature\b", ["signature"]),
    ("ID-17", r"\breligion\b", ["religion"]),
    ("ID-18", r"\bcaste\s*category\b", ["caste"]),
    ("ID-18", r"\breservation\b", ["reservation"]),
    ("ID-20", r"\bcaste\b", ["caste"]),
    ("ID-20", r"\bcommunity\s*certificate\b", ["community"]),
    ("FIN-04", r"\bcibil\b", ["cibil"]),
    ("FIN-04", r"\bcredit\s*score\b", ["credit"]),
    ("FIN-05", r"\bstatement\b", ["statement"]),
    ("FIN-05", r"\bpassbook\b", ["passbook"]),
    ("FIN-09", r"\bsalary\b", ["salary"]),
    ("FIN-09", r"\bincome\b", ["income"]),
    ("FIN-09", r"\bform\s*16\b", ["form"]),
    ("FIN-10", r"\bitr\b", ["itr"]),
    ("FIN-10", r"\btax\s*return\b", ["tax"]),
    ("FIN-11", r"\bctc\b", ["ctc"]),
    ("FIN-11", r"\bgross\s*salary\b", ["gross"]),
    ("BIO-01", r"\bfingerprint\b", ["fingerprint"]),
    ("BIO-02", r"\bvoice\b.*\bauth\b", ["voice"]),
    ("ONL-01", r"\busername\b", ["username"]),
    ("ONL-01", r"\buser\s*id\b", ["user"]),
    ("ONL-01", r"\blogin\s*id\b", ["login"]),
    ("ONL-03", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", []),
    ("ONL-04", r"\bsession\b", ["session"]),
    ("ONL-04", r"\btoken\b", ["token"]),
    ("CHD-01", r"\bminor\b", ["minor"]),
    ("CHD-01", r"\bchild\s*name\b", ["child"]),
    ("CHD-03", r"\bguardian\b", ["guardian"]),
    ("CHD-03", r"\bparent\s*name\b", ["parent"]),
    ("CHD-04", r"\bdisabilit(?:y|ies)\b", ["disabilit"]),
    ("CHD-04", r"\bpwd\b", ["pwd"]),
    ("OTH-01", r"\bcall\s*recording\b", ["recording"]),
    ("OTH-02", r"\bvideo\s*kyc\b", ["kyc"]),
    ("OTH-03", r"\bcctv\b", ["cctv"]),
]
PARAMETERS_WITHOUT_SIGNAL = ["ID-12", "ID-16", "ID-19", "CHD-02", "CHD-05"]

# --------------------------------------------------------------------------
# The rule matrix (rule, screens), severities, sections
# --------------------------------------------------------------------------
RULE_SCREENS = [
    ("RULE-DM-01", ["SCR-02"]),
    ("RULE-DM-02", ["SCR-04"]),
    ("RULE-DM-03", ["SCR-01", "SCR-02", "SCR-07", "SCR-09"]),
    ("RULE-DM-04", ["SCR-06"]),
    ("RULE-DM-05", ["SCR-07"]),
    ("RULE-DM-06", ["SCR-07"]),
    ("RULE-CN-01", ["SCR-01", "SCR-09"]),
    ("RULE-CN-02", ["SCR-10"]),
    ("RULE-CN-03", ["SCR-10"]),
    ("RULE-CN-04", ["SCR-10"]),
    ("RULE-CN-05", ["SCR-05", "SCR-06"]),
    ("RULE-CN-06", ["SCR-11"]),
    ("RULE-SEC-01", ["SCR-13"]),
    ("RULE-SEC-02", ["SCR-03"]),
    ("RULE-SEC-03", ["SCR-12"]),
    ("RULE-SEC-04", ["SCR-13"]),
    ("RULE-SEC-05", ["SCR-01", "SCR-09"]),
    ("RULE-RET-01", ["SCR-03"]),
    ("RULE-RET-02", ["SCR-02", "SCR-03"]),
    ("RULE-CHD-01", ["SCR-01", "SCR-02", "SCR-07"]),
    ("RULE-CHD-02", ["SCR-02", "SCR-11"]),
    ("RULE-CHD-03", ["SCR-02", "SCR-11"]),
    ("RULE-TP-01", ["SCR-11"]),
    ("RULE-TP-02", ["SCR-11"]),
    ("RULE-SEN-01", ["SCR-02", "SCR-03", "SCR-04", "SCR-05", "SCR-06"]),
    ("RULE-SEN-02", ["SCR-02", "SCR-03", "SCR-04", "SCR-05", "SCR-06"]),
    ("RULE-SEN-03", ["SCR-09"]),
    ("RULE-GR-01", ["SCR-01", "SCR-07", "SCR-09"]),
    ("RULE-ACC-01", ["SCR-01", "SCR-02", "SCR-07"]),
]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SECTION_TITLES = {
    "Section 4": "Grounds for processing",
    "Section 5(1)": "Notice",
    "Section 5(1)(i)": "Purpose in notice",
    "Section 5(1)(ii)": "Rights in notice",
    "Section 6": "Consent",
    "Section 6(1)": "Consent requirements / Data minimisation",
    "Section 8(3)": "Data accuracy",
    "Section 8(5)": "Security safeguards",
    "Section 8(7)": "Data retention and erasure",
    "Section 8(9)": "DPO contact publication",
    "Section 8(10)": "Grievance redressal mechanism",
    "Section 9(1)": "Verifiable parental consent",
    "Section 9(3)": "No tracking/targeting children",
}
SECTION_PENALTIES = {
    "Section 8(5)": "Up to ₹250 crore",
    "Section 8(6)": "Up to ₹200 crore",
    "Section 9": "Up to ₹200 crore",
    "Section 9(1)": "Up to ₹200 crore",
    "Section 9(3)": "Up to ₹200 crore",
    "Section 10": "Up to ₹150 crore",
}
DEFAULT_PENALTY = "Up to ₹50 crore"

# Words the rules look for.
RULE_WORDS = {
    "cn01_consent": ["i agree", "consent", "purpose of processing", "withdraw consent",
                     "i accept"],
    "cn02_purpose": ["purpose", "why we collect", "used for", "processing for"],
    "cn03_withdrawal": ["withdraw consent", "right to withdraw", "revoke consent"],
    "cn04_blanket": ["agree to all terms", "consent to use of all your data",
                     "consent to sharing with partners", "agree to all", "consent to all"],
    "cn05_excess": ["contacts", "location access", "camera access", "gallery", "email access"],
    "cn06_optout": ["opt out", "opt-out", "decline", "no thanks", "manage preferences"],
    "sec03_debug": ["stack trace", "traceback", "internal api", "raw database", "exception"],
    "sec05_indicator": ["biometric authentication", "biometric capture", "fingerprint scan"],
    "ret02_closed": ["closed", "dormant", "inactive", "account closed"],
    "chd01_guardian": ["guardian", "parent consent", "minor account", "guardian authorised"],
    "chd03_tracking": ["personalised", "recommended for you", "based on your activity"],
    "tp02_disclosure": ["data sharing", "shared with", "data shared"],
    "sen03_consent": ["consent", "i agree", "i authorize", "permission"],
    "gr01_grievance": ["grievance", "dpo", "data protection officer", "raise concern",
                       "complaint", "nodal officer"],
}
CVV_PATTERN = r"\bcvv\b\s*[:\-]?\s*\d{3}\b"
OTP_PATTERN = r"\b(?:otp|one.time.password)\b.*?\b(\d{4,8})\b"

# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------
FINDING_PENALTY = {"CRITICAL": 18, "HIGH": 10, "MEDIUM": 5, "LOW": 2, "INFO": 0}
DOCUMENT_SENSITIVITY = {
    "Bank Statement": 10,
    "Passbook Screen": 9,
    "KYC Form": 9,
    "Loan/Credit Screen": 8,
    "Account Summary": 8,
    "Transaction Receipt": 7,
    "Profile Screen": 7,
    "Insurance Document": 6,
    "Generic Banking Screen": 5,
    "Unknown/Other": 3,
}
RISK_WEIGHT = {"Critical": 25, "High": 10, "Medium": 4, "Low": 1, "None": 0}
SENSITIVE_DOCUMENTS = ["Bank Statement", "KYC Form", "Passbook Screen"]

# --------------------------------------------------------------------------
# Record of processing activities
# (key, column, header, section, required)
# --------------------------------------------------------------------------
ROPA_COLUMNS = [
    ("serial", "A", "#", "General Information", False),
    ("department", "B", "Department", "General Information", True),
    ("spoc_name", "C", "SPOC Name", "General Information", False),
    ("application_name", "D", "Application/Platform Name", "General Information", True),
    ("process", "E", "Process", "General Information", True),
    ("purpose", "F", "Purpose of processing", "General Information", True),
    ("description", "G", "Description of the data processing", "Process Details", True),
    ("data_principal_cats", "H", "Categories of Data principals involved", "Process Details", True),
    ("includes_children", "I", "Data principals include person with disability/children's",
     "Process Details", True),
    ("child_tracking", "J", "Tracking/behavioural monitoring of children", "Process Details", True),
    ("personal_data_cats", "K", "Categories of Personal Data processed", "Process Details", True),
    ("data_source", "L", "Source of personal data", "Process Details", True),
    ("grounds", "M", "Grounds for processing", "Process Details", True),
    ("consent_type", "N", "Consent type (Physical, Digital)", "Process Details", False),
    ("automated_decisions", "O", "Automated decision making/profiling?",
     "Automated Decision Making", False),
    ("data_principal_rights", "P", "Rights of Data Principals", "Rights of Data Principals", False),
    ("processor_name", "Q", "Data processor(s)", "Processor Information", False),
    ("dpa_in_place", "R", "Data Processing Agreement in place?", "Processor Information", False),
    ("third_party_safeguards", "S", "Security safeguards for third parties",
     "Processor Information", False),
    ("other_recipients", "T", "Other recipients (Internal/External)", "Other Recipients", False),
    ("transfer_outside", "U", "Data transferred outside India?", "Data Transfer", False),
    ("transfer_country", "V", "Country of transfer", "Data Transfer", False),
    ("transfer_purpose", "W", "Purpose of transfer", "Data Transfer", False),
    ("transfer_safeguards", "X", "Transfer security safeguards", "Data Transfer", False),
    ("storage_format", "Y", "Data storage format", "Data Storage", False),
    ("storage_location", "Z", "Where is data stored?", "Data Storage", False),
    ("retention_period", "AA", "Retention period", "Data Storage", False),
    ("retention_purpose", "AB", "Purpose for retention", "Data Storage", False),
    ("dpia_applicable", "AC", "Is DPIA applicable?", "DPIA", False),
    ("dpia_link", "AD", "Link to DPIA record", "DPIA", False),
    ("privacy_notice", "AE", "Covered under Privacy Notice?", "Privacy Notice", False),
]
ROPA_KEYS = [c[0] for c in ROPA_COLUMNS]
ROPA_SCAN_KEYS = [
    "application_name", "data_principal_cats", "includes_children", "child_tracking",
    "personal_data_cats", "consent_type", "storage_format", "data_principal_rights",
    "third_party_safeguards", "transfer_outside",
]
ROPA_INFERRED_KEYS = [
    "department", "process", "purpose", "description", "data_source", "grounds",
    "automated_decisions", "dpia_applicable",
]
ROPA_RIGHTS = (
    "1. Right to access\n2. Right to correction and erasure\n3. Right to grievance redressal\n"
    "4. Right to nominate\n5. Right to withdraw consent"
)
ROPA_SAFEGUARDS = (
    "1. Access control\n2. Encryption/Anonymisation/Pseudonymisation\n3. Logging\n"
    "4. Privacy Training and Awareness"
)
ROPA_APP_PHRASES = [
    ["south", "indian", "bank"],
    ["sibernet"],
    ["sib", "mirror"],
    ["internet", "banking"],
    ["mobile", "banking"],
    ["net", "banking"],
]
ROPA_APP_FOUND = "SIB Mirror+ (Mobile Banking)"
ROPA_APP_DEFAULT = "South Indian Bank Digital Platform"
ROPA_CONSENT_WORDS = ["i agree", "consent", "i accept"]
ROPA_LAW_WORDS = ["kyc", "verification", "aadhaar", "pan"]
ROPA_GROUND_LAW = "Processing to fulfilling any obligation under any law in force in India."
ROPA_GROUND_SERVICE = "Processing is necessary for provision of services"
ROPA_DATA_CATEGORIES = [
    ("KYC-01", "KYC Documents (PAN)"),
    ("KYC-02", "KYC Documents (Aadhaar)"),
    ("KYC-03", "KYC Documents (Passport)"),
    ("KYC-04", "KYC Documents (Voter ID)"),
    ("KYC-05", "KYC Documents (Driving Licence)"),
    ("ID-01", "Identity Data (Name)"),
    ("ID-04", "Identity Data (Phone Number)"),
    ("ID-07", "Identity Data (Email)"),
    ("ID-13", "Identity Data (Customer ID)"),
    ("ID-14", "Identity Data (Identification Number)"),
    ("FIN-01", "Financial Data (Bank Account)"),
    ("FIN-02", "Financial Data (Card Details)"),
    ("FIN-03", "Financial Data (IFSC)"),
    ("FIN-04", "Financial Data (UPI Handle)"),
    ("FIN-05", "Financial Data (Account Balance)"),
    ("FIN-06", "Financial Data (Transaction History)"),
    ("FIN-07", "Financial Data (Transaction Amount)"),
    ("BIO-01", "Biometric Data (Fingerprints)"),
    ("BIO-02", "Biometric Data (Voice Patterns)"),
    ("ONL-01", "Online Identifiers (Username)"),
    ("ONL-02", "Online Identifiers (Password)"),
    ("ONL-03", "Online Identifiers (IP Address)"),
    ("ONL-04", "Online Identifiers (Cookie/Session)"),
    ("CHD-01", "Children Data (Child Name)"),
    ("CHD-02", "Children Data (Child DOB)"),
]
SCREEN_DEPARTMENTS = {
    "Card Management": "Card Operations",
    "Account Summary / Dashboard": "Core Banking",
    "Transaction History / Passbook": "Core Banking",
    "Recharge / Bill Payment": "Digital Banking",
    "Loan / EMI Screen": "Retail Lending",
    "KYC / Onboarding": "Operations",
    "Fund Transfer": "Digital Banking",
    "Profile / Settings": "Core Banking",
    "Login / Authentication": "IT Security",
}
SCREEN_SOURCES = {
    "Card Management": "Internal Systems (Card Management System)",
    "Account Summary / Dashboard": "Internal Systems (Core Banking)",
    "Transaction History / Passbook": "Internal Systems (Core Banking)",
    "KYC / Onboarding": "From Data Principals, Third Party (KYC vendors)",
    "Fund Transfer": "From Data Principals",
    "Profile / Settings": "From Data Principals",
    "Login / Authentication": "From Data Principals",
}
DEFAULT_SOURCE = "From Data Principals"
PERSONAL_DATA_SHEET = [
    ("KYC-01", "KYC Documents", "PAN Details"),
    ("KYC-02", "KYC Documents", "Aadhar details"),
    ("KYC-03", "KYC Documents", "Passport details"),
    ("KYC-04", "KYC Documents", "Voter ID"),
    ("KYC-05", "KYC Documents", "Driving licence details"),
    ("ID-01", "Identity Data", "Name"),
    ("ID-13", "Identity Data", "Identification number (including Customer ID/Employee ID)"),
    ("ID-04", "Identity Data", "Personal Phone Number"),
    ("ID-07", "Identity Data", "Personal Email ID"),
    ("BIO-01", "Biometric Data", "Fingerprints"),
    ("BIO-02", "Biometric Data", "Voice patterns"),
    ("ONL-01", "Online Identifiers", "Username"),
    ("ONL-02", "Online Identifiers", "Passwords"),
    ("ONL-03", "Online Identifiers", "IP Address"),
    ("ONL-04", "Online Identifiers", "Cookie details (location, browsing patterns, etc.)"),
    ("FIN-01", "Financial Data", "Bank account numbers"),
    ("FIN-02", "Financial Data", "Debit Card details"),
    ("FIN-04", "Financial Data", "UPI Handles"),
    ("FIN-05", "Financial Data", "Account balance"),
    ("FIN-06", "Financial Data", "Account transaction history"),
    ("CHD-01", "Children and Person with Disability Data", "Child Name"),
    ("CHD-02", "Children and Person with Disability Data", "Child Date of Birth"),
]


# --------------------------------------------------------------------------
# Dimension DataFrames.  Their size is fixed by this file (fifty rows at most),
# so joins may broadcast them.
# --------------------------------------------------------------------------
def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    return quoted(str(value))


def _dimension(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS dim({names})")


def entity_dim(spark: SparkSession, rules_only: bool = False) -> DataFrame:
    """Entity type -> category, risk, display name."""
    rows = [r for r in ENTITY_CATALOGUE if not (rules_only and r[0] == RULES_ONLY_UNKNOWN_TYPE)]
    return _dimension(spark, rows, "pii_type, category, risk, display_type")


def entity_parameter_dim(spark: SparkSession) -> DataFrame:
    """Entity type -> parameter id, one row each."""
    rows = [(kind, pid) for kind, ids in ENTITY_PARAMETERS for pid in ids]
    return _dimension(spark, rows, "pii_type, pii_id")


def parameter_dim(spark: SparkSession) -> DataFrame:
    """The fifty parameters."""
    return _dimension(spark, PARAMETERS, "pii_id, pii_name, pii_group")


def screen_dim(spark: SparkSession) -> DataFrame:
    """Screen type -> label and legacy document type."""
    rows = [(sid, f"{sid} ({name})", legacy) for sid, name, legacy in SCREEN_NAMES]
    return _dimension(spark, rows, "screen_type, screen_label, legacy_document_type")


def rule_dim(spark: SparkSession) -> DataFrame:
    """Rule x screen type, with the rule's place in the matrix."""
    rows = [(i, rule, sid) for i, (rule, sids) in enumerate(RULE_SCREENS) for sid in sids]
    return _dimension(spark, rows, "rule_order, rule_id, screen_type")


def section_dim(spark: SparkSession) -> DataFrame:
    """Act section -> title and penalty."""
    names = list(dict.fromkeys([*SECTION_TITLES, *SECTION_PENALTIES]))
    rows = [(s, SECTION_TITLES.get(s, ""), SECTION_PENALTIES.get(s)) for s in names]
    return _dimension(spark, rows, "act_section, section_title, penalty")


def personal_data_dim(spark: SparkSession) -> DataFrame:
    """Parameter id -> category and parameter of the personal-data sheet."""
    return _dimension(spark, PERSONAL_DATA_SHEET, "pii_id, category, parameter")


def ropa_field_dim(spark: SparkSession) -> DataFrame:
    """The 31 fields of the record, with header, section and whether required."""
    rows = [(i, *c) for i, c in enumerate(ROPA_COLUMNS)]
    return _dimension(spark, rows, "field_order, field, sheet_column, header, section, required")

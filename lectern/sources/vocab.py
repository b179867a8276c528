"""Fixed values.

Everything in this module is a constant that results depend on: word lists, lookup
tables, labels and limits. They are stated as plain text and in their natural order,
because for the dictionaries and the type priority the order itself is part of the rule.
"""

# --- journals searched every day -------------------------------------------------

CORE_JOURNALS = [
    "European Urology", "Journal of Urology", "BJU International", "Urology",
    "World Journal of Urology", "Nature Reviews Urology", "European Urology Focus",
    "European Urology Oncology", "Prostate Cancer and Prostatic Diseases",
    "Neurourology and Urodynamics", "Journal of Endourology",
    "International Journal of Urology", "Urologic Oncology", "The Prostate",
    "Scandinavian Journal of Urology", "Asian Journal of Urology",
]
ONCOLOGY_JOURNALS = [
    "Journal of Clinical Oncology", "Lancet Oncology", "JAMA Oncology",
    "Annals of Oncology", "Clinical Cancer Research", "Cancer Research", "Cancer",
    "European Journal of Cancer",
]
GENERAL_JOURNALS = [
    "New England Journal of Medicine", "Lancet", "JAMA", "BMJ", "Nature Medicine",
    "JAMA Network Open",
]
TOPIC_WORDS = [
    "urology", "urologic", "prostate", "bladder", "kidney", "renal", "testicular",
]

# --- study type: rules used when an article is ingested ---------------------------

# (type, literals looked for in the joined publication types)
INGEST_PUB_TYPE_RULES = [
    ("rct", ["randomized controlled trial"]),
    ("meta_analysis", ["meta-analysis"]),
    ("case_report", ["case reports"]),
    ("guideline", ["practice guideline", "guideline"]),
]
# (type, literals looked for in title and abstract)
INGEST_TEXT_RULES = [
    ("meta_analysis", ["systematic review", "meta-analysis", "meta analysis", "prisma"]),
    ("rct", ["randomized", "randomised", "rct", "phase ii", "phase iii", "phase 2",
             "phase 3", "double-blind", "placebo-controlled"]),
    ("guideline", ["guideline", "consensus statement", "recommendation statement"]),
    ("ai_ml", ["machine learning", "deep learning", "artificial intelligence",
               "neural network", "convolutional", "transformer model",
               "large language model", "chatgpt"]),
    ("prospective", ["prospective cohort", "prospective study",
                     "prospective observational", "prospectively enrolled",
                     "prospectively collected"]),
    ("retrospective", ["retrospective", "medical records review", "chart review",
                       "database analysis", "registry data", "claims data"]),
    ("basic_research", ["in vitro", "in vivo", "cell line", "mouse model", "xenograft",
                        "knockout", "western blot", "pcr", "immunohistochemistry",
                        "gene expression", "signaling pathway", "molecular mechanism"]),
    ("case_report", ["case report", "case series", "a rare case"]),
]
INGEST_REVIEW_TITLES = ["a review", "narrative review", "current review", "update on"]

# --- paper type -------------------------------------------------------------------

REVIEW_TITLES = ["review", "guideline", "meta-analysis", "systematic review"]
LETTER_TITLES = [
    "reply to", "letter to the editor", "research letter", "letter:", "re:",
    "comment on", "erratum", "corrigendum", "retraction", "correspondence",
]
LETTER_PUB_TYPES = ["letter", "comment", "editorial"]
INGEST_SKIPPED_PAPER_TYPES = ["letter", "editorial"]

# --- study type: dictionary used when articles are reclassified --------------------

STUDY_TYPE_BY_TERM = {
    "randomized controlled trial": "rct",
    "randomized controlled trials as topic": "rct",
    "clinical trial, phase ii": "rct",
    "clinical trial, phase iii": "rct",
    "clinical trial, phase iv": "rct",
    "controlled clinical trial": "rct",
    "retrospective studies": "retrospective",
    "cohort studies": "retrospective",
    "medical records": "retrospective",
    "registries": "retrospective",
    "prospective studies": "prospective",
    "follow-up studies": "prospective",
    "longitudinal studies": "prospective",
    "meta-analysis": "meta_analysis",
    "meta-analysis as topic": "meta_analysis",
    "systematic review": "meta_analysis",
    "systematic reviews as topic": "meta_analysis",
    "animals": "basic_research",
    "mice": "basic_research",
    "rats": "basic_research",
    "cell line, tumor": "basic_research",
    "cell line": "basic_research",
    "xenograft model antitumor assays": "basic_research",
    "tumor microenvironment": "basic_research",
    "signal transduction": "basic_research",
    "gene expression regulation, neoplastic": "basic_research",
    "apoptosis": "basic_research",
    "cell proliferation": "basic_research",
    "biomarkers, tumor": "biomarker",
    "biomarkers": "biomarker",
    "prognosis": "biomarker",
    "liquid biopsy": "biomarker",
    "circulating tumor dna": "biomarker",
    "circulating tumor cells": "biomarker",
    "prostate-specific antigen": "biomarker",
    "genomics": "biomarker",
    "proteomics": "biomarker",
    "transcriptome": "biomarker",
    "machine learning": "ai_ml",
    "deep learning": "ai_ml",
    "artificial intelligence": "ai_ml",
    "neural networks, computer": "ai_ml",
    "robotic surgical procedures": "surgical",
    "laparoscopy": "surgical",
    "minimally invasive surgical procedures": "surgical",
    "nephrectomy": "surgical",
    "prostatectomy": "surgical",
    "cystectomy": "surgical",
    "magnetic resonance imaging": "imaging",
    "tomography, x-ray computed": "imaging",
    "ultrasonography": "imaging",
    "positron-emission tomography": "imaging",
    "radiomics": "imaging",
    "incidence": "epidemiology",
    "prevalence": "epidemiology",
    "risk factors": "epidemiology",
    "health disparities": "epidemiology",
    "survival rate": "epidemiology",
    "practice guideline": "guideline",
    "guideline": "guideline",
    "case reports": "case_report",
}
STUDY_TYPE_PRIORITY = [
    "rct", "meta_analysis", "guideline", "case_report", "ai_ml", "imaging", "biomarker",
    "surgical", "basic_research", "prospective", "retrospective", "epidemiology",
    "review",
]
STUDY_TYPE_TEXTS = {
    "rct": ["randomized", "randomised", "phase ii", "phase iii", "phase 2 ", "phase 3 ",
            "double-blind", "placebo-controlled"],
    "meta_analysis": ["systematic review", "meta-analysis", "meta analysis", "prisma"],
    "retrospective": ["retrospective", "chart review", "database analysis", "registry"],
    "prospective": ["prospective cohort", "prospective study", "prospectively"],
    "basic_research": ["in vitro", "in vivo", "cell line", "mouse model", "xenograft",
                       "knockout mice", "western blot", "signaling pathway"],
    "biomarker": ["biomarker", "prognostic marker", "predictive marker",
                  "liquid biopsy", "circulating tumor"],
    "ai_ml": ["machine learning", "deep learning", "artificial intelligence",
              "neural network", "convolutional", "large language model"],
    "surgical": ["surgical technique", "operative outcome", "robotic-assisted",
                 "robot-assisted"],
    "imaging": ["mri ", "ct scan", "radiomics", "imaging study"],
    "epidemiology": ["incidence", "prevalence", "population-based", "nationwide",
                     "trends in"],
    "guideline": ["guideline", "consensus statement"],
    "case_report": ["case report", "case series", "a rare case"],
    "review": ["a review", "narrative review", "current update", "state of the art"],
}

# --- topic tags: the first key (in this order) found inside a term gives its tag ----

TAG_BY_TERM_PART = {
    "prostatic neoplasms": "prostate",
    "prostate": "prostate",
    "prostatectomy": "prostate",
    "prostate-specific antigen": "prostate",
    "prostatic hyperplasia": "bph",
    "urinary bladder neoplasms": "bladder",
    "cystectomy": "bladder",
    "urinary bladder": "bladder",
    "kidney neoplasms": "kidney",
    "carcinoma, renal cell": "kidney",
    "nephrectomy": "kidney",
    "testicular neoplasms": "testicular",
    "adrenal cortex neoplasms": "adrenal",
    "urolithiasis": "stone",
    "kidney calculi": "stone",
    "urinary incontinence": "incontinence",
    "kidney transplantation": "transplant",
    "erectile dysfunction": "andrology",
    "infertility, male": "andrology",
    "immunotherapy": "immunotherapy",
    "immune checkpoint inhibitors": "immunotherapy",
    "molecular targeted therapy": "targeted_therapy",
    "radiotherapy": "radiation",
    "brachytherapy": "radiation",
    "drug therapy": "chemotherapy",
    "antineoplastic agents": "chemotherapy",
    "robotic surgical procedures": "robotic",
    "laparoscopy": "laparoscopic",
    "survival analysis": "survival",
    "survival rate": "survival",
    "quality of life": "quality_of_life",
    "mass screening": "screening",
    "early detection of cancer": "screening",
    "diagnosis": "diagnosis",
    "cost-benefit analysis": "cost_effectiveness",
}

# --- what is never recommended ----------------------------------------------------

BATCH_SKIPPED_PAPER_TYPES = ["letter", "comment", "erratum", "editorial"]
BATCH_SKIPPED_TITLES = [
    "reply to", "letter to the editor", "research letter", "letter:", "re:",
    "comment on", "erratum", "corrigendum", "retraction", "editorial", "correspondence",
]
INSTANT_SKIPPED_TITLES = [
    "reply to", "letter to", "research letter", "letter:", "re:", "erratum",
    "editorial", "comment on", "correspondence",
]
MIN_ABSTRACT_CHARS = 100

# --- scoring ----------------------------------------------------------------------

WEIGHT_CONTENT = 0.30
WEIGHT_BEHAVIOUR = 0.25
WEIGHT_COLLABORATIVE = 0.25
WEIGHT_TEMPORAL = 0.20
SCORE_SCALE = 15.0
REVIEW_BOOST = 1.3
STUDY_TYPE_BOOST = 1.25

# --- labels -----------------------------------------------------------------------

REASON_LEARNED = "Based on your likes"
REASON_READING = "Based on your reading"
REASON_FRESH = "Recent publication"
REASON_REVIEW = "Review / Meta-analysis"

STUDY_TYPE_LABELS = {
    "rct": "Clinical Trial",
    "basic_research": "Basic Research",
    "biomarker": "Biomarker",
    "retrospective": "Retrospective",
    "prospective": "Prospective",
    "meta_analysis": "Meta-analysis",
    "ai_ml": "AI / ML",
    "surgical": "Surgical",
    "imaging": "Imaging",
    "epidemiology": "Epidemiology",
    "guideline": "Guideline",
    "review": "Review",
}
BADGE_LABELS = {
    "rct": "RCT",
    "basic_research": "Basic Research",
    "biomarker": "Biomarker",
    "retrospective": "Retrospective",
    "prospective": "Prospective",
    "meta_analysis": "Meta-analysis",
    "ai_ml": "AI / ML",
    "surgical": "Surgical",
    "imaging": "Imaging",
    "epidemiology": "Epidemiology",
    "guideline": "Guideline",
    "review": "Review",
    "case_report": "Case Report",
    "other": "Article",
}

# Terms that say nothing about a reader's topics.
TOPIC_STOP_TERMS = [
    "humans", "male", "female", "aged", "middle aged", "aged, 80 and over", "adult",
    "young adult", "adolescent", "child", "animals", "treatment outcome",
    "follow-up studies", "time factors", "prognosis", "risk factors",
    "retrospective studies", "prospective studies", "cohort studies", "prevalence",
    "incidence", "survival rate", "survival analysis", "proportional hazards models",
    "multivariate analysis", "logistic models", "predictive value of tests",
    "sensitivity and specificity", "reproducibility of results", "reference values",
    "risk assessment", "united states", "europe", "japan", "korea", "china",
    "journal article", "research support", "english abstract", "comparative study",
    "multicenter study", "randomized controlled trial", "evaluation study",
    "clinical trial", "practice guideline", "meta-analysis", "systematic review",
    "review", "case reports", "editorial", "letter", "comment",
]

# Suggested keywords shown to a new reader.
KEYWORD_CATALOGUE = {
    "Oncology": [
        "prostate cancer", "bladder cancer", "kidney cancer", "testicular cancer",
        "upper tract urothelial carcinoma", "immunotherapy", "targeted therapy"],
    "Endourology & Stones": [
        "urolithiasis", "stone disease", "PCNL", "ureteroscopy",
        "shock wave lithotripsy", "metabolic stone evaluation"],
    "Functional & Female": [
        "overactive bladder", "BPH", "neurogenic bladder", "incontinence",
        "pelvic organ prolapse", "urodynamics"],
    "Surgery & Technology": [
        "robotic surgery", "minimally invasive surgery", "laparoscopy",
        "surgical technique", "3D printing", "AI"],
    "Transplant & Reconstruction": [
        "kidney transplant", "urinary diversion", "urethroplasty",
        "reconstructive urology"],
    "Research Methods": [
        "biomarker", "genomics", "clinical trial", "meta-analysis", "epidemiology",
        "machine learning"],
}

# English stop words of the text index (the list PostgreSQL ships for 'english').
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()

# --- table domains ----------------------------------------------------------------

FEEDBACK_ACTIONS = ["like", "dislike", "save"]
DIGEST_FREQUENCIES = ["daily", "weekly"]
ALERT_TYPES = ["keyword", "author", "journal"]
LIKED_COLLECTION_NAME = "Liked Papers"
LIKED_COLLECTION_COLOR = "#34C759"
DEFAULT_COLLECTION_COLOR = "#007AFF"
DELETED_NAME = "[DELETED]"
ARTICLE_URL = "https://pubmed.ncbi.nlm.nih.gov/"
DOI_URL = "https://doi.org/"

MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

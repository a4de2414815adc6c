"""Word lists, tables and patterns that define the results."""

EXPERIENCE_NAMES = (
    "experience", "experiences", "work experience", "professional experience", "employment history",
    "employment", "employment summary", "career history", "work history", "professional background",
)
SUMMARY_NAMES = (
    "professional summary", "summary", "objective", "career objective", "profile", "professional profile",
    "about me", "career summary", "executive summary", "professional overview", "general info",
    "general information", "about",
)
SKILLS_NAMES = (
    "technical skills", "skills", "skill", "core competencies", "competencies", "technical expertise",
    "expertise", "key skills", "areas of expertise", "technologies", "tech stack",
)
EDUCATION_NAMES = (
    "education", "academic background", "academic credentials", "educational background",
    "educational history", "degrees",
)
CERTIFICATIONS_NAMES = (
    "certifications", "certification", "licenses", "license", "certifications and training",
    "training and certifications", "training", "courses", "professional development",
)
LANGUAGES_NAMES = ("languages", "language skills")
WEBSITES_NAMES = (
    "websites", "profiles", "social profiles", "links", "portfolio", "web profiles", "online profiles",
)
OTHER_NAMES = (
    "publications", "projects", "volunteer", "volunteering", "awards", "honors", "references", "interests",
    "activities", "leadership", "leadership experience", "additional information", "communication",
    "contact information", "contact info", "affiliations", "additional", "my qualifications",
    "personal references", "personal reference", "accomplishments", "achievement", "achievements",
    "skills and abilities", "education summary",
)
NAMES_BY_TYPE = {
    "experience": EXPERIENCE_NAMES, "summary": SUMMARY_NAMES, "skills": SKILLS_NAMES,
    "education": EDUCATION_NAMES, "certifications": CERTIFICATIONS_NAMES, "languages": LANGUAGES_NAMES,
    "websites": WEBSITES_NAMES, "other": OTHER_NAMES,
}

# Section aliases of the placement scorer (keys in normalised form).
SECTION_ALIASES = {
    "summary": (
        "professional summary", "summary", "profile", "professional profile", "career summary", "about me",
        "executive summary", "objective", "career objective", "professional objective", "about", "overview",
    ),
    "experience": (
        "experience", "professional experience", "employment history", "work experience", "career history",
        "work history", "professional background", "employment",
    ),
    "education": (
        "education", "academic background", "education and training", "educational background", "degrees",
        "academic credentials", "education and credentials",
    ),
    "skills": (
        "technical skills", "skills", "skill", "core competencies", "technical proficiencies", "expertise",
        "competencies", "key skills", "areas of expertise", "technologies", "tech stack",
        "technical expertise", "technology stack",
    ),
    "languages": ("languages", "language", "spoken languages", "languages and frameworks"),
    "certifications": (
        "certifications", "certifications and training", "training", "licenses", "certification", "licences",
        "certificates",
    ),
}

# Known section keys of the comparator (letters and digits only).
KNOWN_SECTION_KEYS = (
    "summary", "professionalsummary", "objective", "careerobjective", "profile", "professionalprofile", "aboutme",
    "careersummary", "executivesummary", "experience", "workexperience", "professionalexperience",
    "employmenthistory", "employment", "careerhistory", "workhistory", "professionalbackground", "skills",
    "technicalskills", "corecompetencies", "competencies", "technicalexpertise", "expertise", "keyskills",
    "areasofexpertise", "technologies", "techstack", "education", "academicbackground", "academiccredentials",
    "educationalbackground", "degrees", "projects", "certifications", "certification", "publications", "awards",
    "honors", "languages", "references", "activities", "volunteer", "volunteering", "leadership", "interests",
    "additionalinformation",
)

EDUCATION_KEYWORDS = (
    "bachelor", "master", "phd", "mba", "degree", "diploma", "university", "college", "institute", "faculty",
    "honours", "honors", "graduate", "undergraduate",
)
TECH_KEYWORDS = (
    "python", "javascript", "typescript", "golang", "scala", "kotlin", "docker", "kubernetes", "terraform",
    "ansible", "postgres", "postgresql", "mongodb", "elasticsearch", "kafka", "rabbitmq", "kinesis", "serverless",
    "lambda", "react", "angular", "nextjs", "nodejs", "django", "fastapi", "flask", "spring", "graphql", "restful",
    "tensorflow", "pytorch", "sklearn", "pandas", "numpy", "airflow", "devops", "microservice", "microservices",
)
ACTION_VERBS = (
    "built", "introduced", "created", "developed", "led", "managed", "designed", "implemented", "delivered",
    "achieved", "increased", "reduced", "improved", "launched", "established", "collaborated", "conducted", "worked",
    "helped", "supported", "analyzed", "drove", "owned", "partnered", "spearheaded", "scaled", "automated",
    "migrated", "refactored", "deployed", "maintained", "integrated", "contributed", "ensured", "provided",
    "coordinated", "facilitated", "executed",
)
TITLE_MERGE_STOP_WORDS = (
    "experience", "work", "employment", "career", "education", "academic", "qualifications", "skills",
    "competencies", "expertise", "technologies", "summary", "objective", "profile", "overview", "about", "projects",
    "certifications", "certificates", "licenses", "awards", "achievements", "honors", "accomplishments",
)
PROPER_NOUNS = {
    "redis": "Redis", "kafka": "Kafka", "rabbitmq": "RabbitMQ", "aws": "AWS", "oauth2": "OAuth2", "oidc": "OIDC",
    "saml": "SAML", "jwt": "JWT", "rbac": "RBAC", "mysql": "MySQL", "postgresql": "PostgreSQL", "docker": "Docker",
    "kubernetes": "Kubernetes", "api": "API", "llm": "LLM", "rag": "RAG", "ai": "AI", "sql": "SQL", "rest": "REST",
    "graphql": "GraphQL", "websockets": "WebSockets", "grpc": "gRPC", "ci": "CI", "cd": "CD", "cicd": "CI/CD",
    "vba": "VBA", "css": "CSS", "html": "HTML", "xml": "XML", "json": "JSON", "yaml": "YAML",
}
COMMON_PREFIX_WORDS = (
    "in", "on", "at", "to", "of", "by", "an", "as", "or", "up", "do", "is", "it", "be", "we", "he", "if", "so",
)

# Characters.
PRIVATE_USE = r"[\x{e000}-\x{f8ff}]"
BULLET_GLYPHS = "•·▪▸◦→›●○■□◆◇✓✔✗✘"
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb00": "ff", "\ufb05": "ft", "\ufb06": "st"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff\u2060"
SPACE_VARIANTS = "\u00a0\u202f\u2009\u2007"

# Patterns.
WORD = r"[\p{L}\p{N}_]+"
YEAR_IN_TEXT = r"(?<![\p{L}\p{N}_])(?:19|20)[0-9]{2}(?![\p{L}\p{N}_])"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
LETTER_DATE = rf"(?i)\b(?:{MONTHS})\s+[0-9]{{1,2}}(?:[a-z]{{1,2}})?,?\s*[0-9]{{4}}\b"
MONTH_SHORT = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:[a-z]*)\.?"
YEAR_SLOT = r"(?:(?:19|20)[0-9]{2}|(?:19|20)[Xx]{2})"
DATE_LINE = (
    rf"(?i)^\s*(?:{MONTH_SHORT}\s+)?{YEAR_SLOT}"
    rf"(?:\s*[-–—]\s*(?:(?:{MONTH_SHORT}\s+)?(?:{YEAR_SLOT}|(?:Present|Current|Now|Ongoing))))?\s*$"
)
INTERNAL_MARKER = r"(?i)\{\{|\}\}|CURRENT_DATE|\[TODO\]|\[PLACEHOLDER\]|\[YOUR\s"
INTERNAL_MARKERS = ("CURRENT_DATE", "{{", "}}", "__TEMPLATE__", "Generated on")
PLACEHOLDERS = ("[firstname]", "[lastname]", "[name]", "firstname lastname")
GLUED_HEADING = r"^([A-Z][A-Z &/]{2,}?)([A-Z][a-z].*)$"
CURRENT_DATE_LINE = r"(?i)^\s*Current\s+Date\s*:"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?[0-9\s().-]{7,20}"
LINKEDIN = r"(?i)linkedin\.com/in/[\p{L}\p{N}_-]+"
GITHUB = r"(?i)github\.com/[\p{L}\p{N}_-]+"
LABEL_PATTERNS = {
    "languages": r"(?i)^(?:languages?|spoken\s+languages?)\s*[:：]\s*",
    "certifications": r"(?i)^(?:certifications?(?:\s+and\s+training)?|licenses?|licences?)\s*[:：]\s*",
    "links": r"(?i)^(?:websites?|profiles?|links?|github|linkedin|portfolio|online)\s*[:：]\s*",
    "awards": r"(?i)^(?:awards?|honors?|honours?|achievements?)\s*[:：]\s*",
}
PROFICIENCY = (
    r"(?i)\b(?:native|fluent|advanced|intermediate|basic|beginner|elementary|professional|working|"
    r"conversational|proficien\w*|mother\s+tongue)\b|\b[ABC][12]\b"
)
PROGRAMMING_LANGUAGE = (
    r"(?i)\b(?:java|kotlin|typescript|javascript|python|golang|go|rust|scala|php|ruby|swift|sql|html|css|bash|"
    r"shell|perl|dart|groovy|matlab|fortran|cobol|haskell|clojure|erlang|elixir|node(?:\.js)?|js|ts)\b|c\+\+|c#"
)
TECH_STACK_LINE = (
    r"(?i)^(?:Tech(?:nology|nologies)?\s+Stack|Key\s+Tech(?:nologies)?|Technologies|Tools|Infrastructure|"
    r"Dev(?:Ops|Tools)|Stack|Frameworks?|Languages?|Platforms?)\s*:"
)
HIGHLIGHT_LINE = r"(?i)^Highlights?\s*:"
ACCENTS_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
ACCENTS_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

"""Word lists, patterns and tables whose values the results depend on. All of them are fixed values, and all are defaults of parameters."""

from __future__ import annotations

# Topic words of sustainability disclosures, matched as whole tokens.
ESG_KEYWORDS = (
    "environment environmental emission emissions carbon greenhouse ghg climate renewable energy waste water biodiversity deforestation "
    "pollution recycling sustainability sustainable footprint ecological ecology solar wind biomass effluent afforestation reforestation "
    "conservation habitat species wetland watershed decarbonization decarbonisation circular cleanenergy netzero carbonneutral climaterisk "
    "social community diversity inclusion gender equity employee employees workforce training health safety wellbeing welfare humanrights "
    "labour labor discrimination harassment posh parental maternity paternity disability indigenous marginalized vulnerable livelihood "
    "empowerment education nutrition sanitation childlabour forcedlabour fairwage minimumwage governance transparent transparency "
    "accountability compliance ethics ethical integrity stakeholder disclosure policy policies regulation regulatory audit risk materiality "
    "esg csr responsibility responsible impact initiative target goal commitment whistleblower anticorruption antibribery supplychain vendor "
    "supplier grievance redressal brsr ngrbc sdg ungc gri sasb tcfd reporting assurance verification framework"
).split()

# Stopwords of company reports, for the tone metrics.
REPORT_STOPWORDS = (
    "crore lakh pursuant herein hereinafter viz sebi brsr bsr fy rin cin din llp ltd limited india indian company companies annual report "
    "financial year quarter board director directors meeting held said per also may shall would could within thereof therein hereby whereas "
    "aforesaid amongst abovementioned hereunder thereunder thereto therewith therefrom whereof whereon notwithstanding aforementioned "
    "accordingly andor nil na total sub grand please etc ibid"
).split()

# Stopwords of company reports, for the cleaning of page text.
DOMAIN_STOPWORDS = (
    "crore lakh pursuant herein hereinafter viz sebi brsr bsr fy rin cin din llp ltd limited india indian company companies annual report "
    "financial year quarter board director directors meeting held said per also may shall would could within thereof therein hereby whereas "
    "aforesaid amongst abovementioned hereunder thereunder thereto therewith therefrom wherefrom whereof whereon whereto whereupon whereby "
    "notwithstanding aforementioned accordingly andor nil na total sub grand please etc ibid supra infra"
).split()

# English stopwords, for the cleaning of page text.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself he him his himself she her hers herself it its itself they them their "
    "theirs themselves a an and if or because as until while of at by for with without after upon between into through during before above "
    "below to from up down in out on off over under again further then once here there all any both each few more most other some such no nor "
    "not only own same so than that the these those unto were has have having is are was be been being does did doing will would should could "
    "may might must this"
).split()

# Stopwords of the severity index, beside a list of English ones.
INDEX_STOPWORDS = (
    "company companies report reporting annual year page table figure note section see also including may will shall per cent please pursuant "
    "thereof herein hereby whereas ltd inc plc corp group holding limited january february march april june july august september october "
    "november december www http https com org net"
).split()

# Disclosure terms by pillar, matched as substrings of uni- and bigrams.
ENVIRONMENTAL_TERMS = [
    "materials", "raw materials", "recycled materials", "material consumption",
    "energy", "energy consumption", "energy intensity", "renewable energy", "non-renewable energy", "energy efficiency", "fuel consumption",
    "water", "water withdrawal", "water consumption", "water discharge", "water stress", "water recycling",
    "biodiversity", "habitat", "ecosystem", "protected area", "species",
    "emissions", "carbon", "greenhouse gas", "ghg", "scope 1", "scope 2", "scope 3", "carbon dioxide", "co2", "carbon footprint",
    "carbon neutral", "net zero", "carbon emissions", "emission reduction", "carbon intensity",
    "waste", "hazardous waste", "non-hazardous waste", "waste disposal", "recycling", "waste diversion", "landfill",
    "environmental compliance", "environmental fine", "environmental penalty",
    "supplier environmental", "environmental supply chain",
    "climate change", "climate risk", "climate strategy", "deforestation", "pollution", "air quality", "clean energy",
    "environmental impact", "environmental management", "environmental performance", "sustainability", "sustainable", "green",
    "decarbonization", "carbon capture",
]
SOCIAL_TERMS = [
    "employment", "employee", "workforce", "hiring", "turnover", "benefits", "parental leave",
    "labor relations", "collective bargaining", "trade union",
    "health and safety", "occupational health", "injury", "fatality", "lost time", "safety management", "near miss",
    "training", "education", "learning", "skill development", "employee development", "professional development",
    "diversity", "inclusion", "equal opportunity", "gender", "women", "minority", "pay equity", "gender pay gap",
    "non-discrimination", "discrimination", "harassment",
    "freedom of association", "collective agreement",
    "child labor", "forced labor", "modern slavery", "human trafficking", "security practices", "human rights training",
    "indigenous rights", "indigenous peoples",
    "community", "community engagement", "social impact", "local community",
    "supplier social", "supply chain human rights", "social supply chain",
    "public policy", "lobbying", "political contribution",
    "customer health", "product safety", "customer safety", "marketing", "labeling", "product information",
    "customer privacy", "data privacy", "data protection", "socioeconomic", "social compliance",
    "human rights", "social responsibility", "stakeholder", "philanthropy", "social performance",
]
GOVERNANCE_TERMS = [
    "economic performance", "financial assistance", "government assistance",
    "market presence", "local hiring", "senior management",
    "indirect economic", "infrastructure investment", "community investment",
    "procurement", "local supplier", "supplier",
    "anti-corruption", "corruption", "bribery", "anti-bribery", "whistleblower", "ethics", "code of conduct",
    "anti-competitive", "competition", "monopoly",
    "board", "board independence", "board diversity", "board composition", "executive compensation", "remuneration", "shareholder",
    "shareholder rights", "audit", "audit committee", "risk management", "internal control", "transparency", "disclosure",
    "accountability", "governance", "corporate governance", "compliance", "regulatory", "policy", "oversight", "fiduciary",
    "esg governance", "esg committee", "sustainability governance", "materiality", "stakeholder engagement",
]

# Phrases that mark a page of financial statements (searched, ignoring case, in a page's first 800 characters).
FINANCIAL_PATTERNS = [
    r"balance sheet",
    r"auditor.{0,10}report",
    r"cash flow statement",
    r"notes to (the )?financial",
    r"statement of profit",
    r"standalone financial",
    r"consolidated financial",
    r"independent auditor",
    r"board of directors report",
    r"profit and loss",
    r"income statement",
    r"schedule[s]? forming",
    r"significant accounting policies",
]

# Boilerplate, each replaced by a space in this order, by line and ignoring case.
BOILERPLATE_PATTERNS = [
    r"page\s+\d+\s+of\s+\d+",
    r"^\s*\d+\s*$",
    r"confidential.*?$",
    r"for\s+internal\s+use\s+only",
    r"annual\s+report\s+20\d{2}[-–]\d{2,4}",
    r"business\s+responsibility\s+(&|and)\s+sustainability\s+report",
    r"^\s*(sl\.?\s*no\.?|sr\.?\s*no\.?|s\.?\s*no\.?)\s*$",
]

# Headings of a sustainability section, in the order in which they are tried.
SECTION_PATTERNS = {
    "Principle 1": r"(?:Principle|Section)\s*[1I][:\s\-]*(?:Business\s*Ethics|Conduct|Governance)",
    "Principle 2": r"(?:Principle|Section)\s*2[:\s\-]*(?:Product|Service|Quality|Safety)",
    "Principle 3": r"(?:Principle|Section)\s*3[:\s\-]*(?:Employees|Wellbeing|Welfare|Workforce)",
    "Principle 4": r"(?:Principle|Section)\s*4[:\s\-]*(?:Stakeholders|Inclusive|Value\s*Chain)",
    "Principle 5": r"(?:Principle|Section)\s*5[:\s\-]*(?:Human\s*Rights|Diversity|Inclusion)",
    "Principle 6": r"(?:Principle|Section)\s*6[:\s\-]*(?:Environment|Pollution|Waste|Resource)",
    "Principle 7": r"(?:Principle|Section)\s*7[:\s\-]*(?:Policy|Public|Advocacy|Enforcement)",
    "Principle 8": r"(?:Principle|Section)\s*8[:\s\-]*(?:Technology|Access|Digital|Innovation)",
    "Principle 9": r"(?:Principle|Section)\s*9[:\s\-]*(?:Value\s*Chain|Customers|Suppliers)",
    "BRSR": r"BRSR|Business Responsibility and Sustainability Reporting",
    "BRR": r"Business Responsibility Report",
    "Section A": r"Section\s*A[:\s\-].*?(?:General|Disclosures)",
    "Section B": r"Section\s*B[:\s\-].*?(?:Management|Process)",
    "Section C": r"Section\s*C[:\s\-].*?(?:Principle|Performance)",
}

# The bank that holds where no template is given, and its keywords.
DEFAULT_KEYWORDS = ["BRSR", "Business Responsibility", "Sustainability Report", "ESG", "Principle", "Indicator"]
MAIN_PATTERNS = {"BRSR_Main": r"BRSR|Business Responsibility and Sustainability Reporting", "BRR_Main": r"Business Responsibility Report"}

# Ways in which a year of incorporation is told; the first pattern that matches anywhere wins.
INCORPORATION_PATTERNS = [
    r"Year of Incorporation\s*[:.]?\s*(\d{4})",
    r"Incorporation\s*Year\s*[:.]?\s*(\d{4})",
    r"3\.\s*Year of Incorporation\s*[:.]?\s*(\d{4})",
    r"Year of Incorporation\s*-\s*(\d{4})",
    r"Incorporated\s*in\s*(\d{4})",
    r"Date of Incorporation\s*[:.]?\s*.*?(\d{4})",
    r"Incorporation Date\s*[:.]?\s*.*?(\d{4})",
    r"Year of incorporation\s*[:.]?\s*(\d{4})",
]

# Ticker, company, sector, industry, for tickers whose page tells nothing.
FALLBACK_COMPANIES = [
    ("JIOFIN", "Jio Financial Services Ltd", "Financial Services", "Financial Services"),
    ("RELIANCE", "Reliance Industries Ltd", "Energy", "Oil, Gas & Consumable Fuels"),
    ("TCS", "Tata Consultancy Services Ltd", "IT", "IT - Software"),
    ("INFY", "Infosys Ltd", "IT", "IT - Software"),
    ("HDFCBANK", "HDFC Bank Ltd", "Financial Services", "Banks"),
    ("ICICIBANK", "ICICI Bank Ltd", "Financial Services", "Banks"),
    ("ITC", "ITC Ltd", "Consumer Goods", "Diversified"),
    ("WIPRO", "Wipro Ltd", "IT", "IT - Software"),
]

# Categories of a tone lexicon, and the columns of a master dictionary that hold them.
TONE_CATEGORIES = {
    "Positive": "Positive",
    "Negative": "Negative",
    "Uncertainty": "Uncertainty",
    "Litigious": "Litigious",
    "Strong": "Strong_Modal",
    "Weak": "Weak_Modal",
    "Constraining": "Constraining",
    "Complexity": "Complexity",
}

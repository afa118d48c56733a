"""Domain texts and keyword lists that decide a classification."""

STOP_WORDS = (
    "a", "about", "above", "after", "again", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be",
    "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could", "did", "do",
    "does", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "he", "her", "here",
    "him", "his", "how", "if", "in", "interest", "into", "is", "it", "its", "last", "least", "made", "many", "me", "more", "most", "my", "name", "no", "nor", "not", "of",
    "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "part", "same", "she", "so", "some", "such",
    "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "top", "under", "until", "up", "very", "via", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom",
    "why", "will", "with", "would", "you", "your",
)

DOMAIN_CORPORA = {
    "healthcare": (
        "patient diagnosis disease symptom bmi blood pressure cholesterol age hospital medicine "
        "treatment readmission mortality clinical glucose insulin pulse heartrate heart rate doctor clinic "
        "surgery stay discharge physician vital lab test dosage therapy pathology ward oncology cardiology "
        "icu inpatient outpatient emergency triage creatinine hemoglobin bilirubin medical records"
    ),
    "human_resources": (
        "employee attrition salary department job role tenure performance hiring turnover satisfaction overtime "
        "leave promotion work life balance manager staff compensation bonus rating experience education level "
        "retention headcount payroll appraisal performance score engagement resignation absenteeism recruitment"
    ),
    "sales_commercial": (
        "sales revenue product customer price unit price units sold discount profit order cost margin "
        "region channel transaction quota commission deal pipeline lead client market gross net "
        "invoice cart checkout shipping churn purchase billing total retail gross margin e commerce"
    ),
    "supply_chain_inventory": (
        "inventory stock warehouse reorder lead time safety stock supplier sku holding cost turnover "
        "backorder batch size logistics fulfillment shipping freight delivery transit shelf life stockout restock "
        "procurement distribution container pallet supply chain transport cargo bin location units in stock"
    ),
    "automotive": (
        "car vehicle fuel mileage engine model manufacturer transmission horsepower price sales dealer brand "
        "sedan suv electric hybrid mpg displacement wheelbase curb weight fuel capacity resale efficiency "
        "cylinder torque acceleration odometer vin registration speed drive type ev battery"
    ),
    "finance_banking": (
        "revenue profit loss interest rate inflation stock investment loan credit debt income "
        "expense tax gdp market portfolio dividend equity liability asset balance default borrower "
        "credit score interest yield deposit transaction mortgage mortgage risk delinquency apr capital cash flow"
    ),
    "education": (
        "student grade gpa score exam attendance marks course teacher school university pass "
        "fail homework test quiz degree study subject math science english reading writing "
        "semester admission faculty credits scholarship alumni syllabus test score academic progress"
    ),
}

PRIMARY_METRICS = {
    "healthcare": ("glucose", "bmi", "blood_pressure", "cholesterol", "stay_duration", "cost", "readmission"),
    "human_resources": ("salary", "performance_score", "satisfaction_level", "tenure", "overtime_hours", "compensation"),
    "sales_commercial": ("revenue", "sales", "profit", "units_sold", "price", "cost", "margin", "tax"),
    "supply_chain_inventory": ("stock_level", "lead_time", "holding_cost", "reorder_point", "units_in_stock", "turnover_rate"),
    "automotive": ("sales_in_thousands", "price", "price_in_thousands", "horsepower", "fuel_efficiency", "mpg", "engine_size"),
    "finance_banking": ("balance", "loan_amount", "interest_rate", "income", "credit_score", "debt_ratio", "profit"),
    "education": ("final_grade", "gpa", "attendance_rate", "score", "math", "science", "english", "marks"),
}

PRIMARY_DIMENSIONS = {
    "healthcare": ("diagnosis", "treatment", "gender", "age_group", "department", "hospital", "patient_id"),
    "human_resources": ("department", "job_role", "gender", "education", "marital_status", "performance_rating"),
    "sales_commercial": ("region", "category", "product", "channel", "customer_segment", "country", "sales_rep"),
    "supply_chain_inventory": ("warehouse", "supplier", "sku", "category", "shipping_mode", "location"),
    "automotive": ("manufacturer", "model", "vehicle_type", "transmission", "fuel_type", "drive_type"),
    "finance_banking": ("account_type", "loan_grade", "risk_category", "branch", "currency", "employment_status"),
    "education": ("gender", "grade_level", "major", "subject", "school", "section", "semester"),
}

DOMAIN_KEYWORDS = {
    "sales": (
        "sales", "revenue", "product", "customer", "price", "unit_price", "units_sold", "discount", "profit", "order",
        "cost", "margin", "region", "channel", "transaction", "quota", "commission", "pipeline", "lead", "gross", "net",
        "invoice", "cart", "checkout", "shipping", "purchase", "billing", "retail", "ecommerce", "e-commerce",
    ),
    "finance": (
        "revenue", "profit", "loss", "interest", "rate", "inflation", "stock", "investment", "loan", "credit", "debt",
        "income", "expense", "tax", "gdp", "market", "portfolio", "dividend", "equity", "liability", "asset", "balance",
        "default", "borrower", "credit_score", "yield", "deposit", "mortgage", "delinquency", "apr", "cash_flow", "risk",
    ),
    "healthcare": (
        "patient", "diagnosis", "disease", "symptom", "bmi", "blood_pressure", "blood", "pressure", "cholesterol", "age",
        "hospital", "medicine", "treatment", "readmission", "mortality", "clinical", "glucose", "insulin", "pulse",
        "heartrate", "heart_rate", "doctor", "clinic", "surgery", "stay", "discharge", "vital", "lab", "therapy", "ward",
        "icu", "inpatient", "outpatient", "triage", "creatinine", "hemoglobin",
    ),
    "hr": (
        "employee", "attrition", "salary", "department", "job_role", "tenure", "performance", "turnover", "satisfaction",
        "overtime", "leave", "promotion", "work_life_balance", "manager", "compensation", "bonus", "rating", "experience",
        "retention", "headcount", "payroll", "appraisal", "engagement", "resignation", "recruitment", "hire_date",
    ),
    "education": (
        "student", "grade", "gpa", "score", "exam", "attendance", "marks", "course", "teacher", "school", "university",
        "pass", "fail", "homework", "test", "quiz", "degree", "study", "subject", "math", "science", "english",
        "semester", "credits",
    ),
    "marketing": (
        "campaign", "clicks", "impressions", "ctr", "cpc", "cpa", "conversion", "leads", "channel", "ad_spend", "spend",
        "roas", "roi", "bounce_rate", "traffic", "visitor", "engagement", "newsletter", "subscriber", "acquisition",
        "utm_source", "medium",
    ),
    "inventory": (
        "inventory", "stock", "warehouse", "reorder", "lead_time", "supplier", "sku", "holding_cost", "turnover",
        "backorder", "logistics", "fulfillment", "shipping", "freight", "delivery", "pallet", "cargo", "shelf_life",
        "stockout", "batch",
    ),
    "automotive": (
        "car", "vehicle", "fuel", "mileage", "engine", "model", "transmission", "horsepower", "price", "dealer", "brand",
        "sedan", "suv", "electric", "hybrid", "mpg", "displacement", "wheelbase", "curb_weight", "odometer", "vin",
        "speed", "battery",
    ),
    "real_estate": (
        "property", "house", "home", "apartment", "price", "rent", "bedroom", "bathroom", "sqft", "square_feet", "area",
        "zip_code", "neighborhood", "mortgage", "listing", "lot_size", "year_built", "stories", "real_estate", "tenant",
        "landlord", "yield",
    ),
    "customer_analytics": (
        "customer", "client", "churn", "retention", "ltv", "lifetime_value", "nps", "csat", "satisfaction", "tenure",
        "contract", "subscription", "monthly_charges", "total_charges", "support_tickets", "tier", "plan", "loyalty",
        "referral",
    ),
}

FALLBACK_KEYWORDS = {
    "education": (
        "student", "grade", "gpa", "score", "exam", "attendance", "marks", "course", "teacher", "school", "university",
        "pass", "fail", "homework", "test", "quiz", "degree", "study",
    ),
    "healthcare": (
        "patient", "diagnosis", "disease", "symptom", "bmi", "blood", "pressure", "cholesterol", "age", "hospital",
        "medicine", "treatment", "readmission", "mortality", "clinical", "glucose", "insulin", "pulse", "heartrate",
        "heart_rate",
    ),
    "automobile": (
        "car", "vehicle", "fuel", "mileage", "engine", "model", "transmission", "horsepower", "price", "sales", "dealer",
        "manufacturer", "brand", "sedan", "suv", "electric", "hybrid", "mpg", "displacement",
    ),
    "finance": (
        "revenue", "profit", "loss", "interest", "rate", "inflation", "stock", "investment", "loan", "credit", "debt",
        "income", "expense", "tax", "gdp", "market", "portfolio", "dividend", "equity", "liability", "asset", "balance",
    ),
    "sales": (
        "sales", "revenue", "product", "customer", "price", "unit_price", "units_sold", "discount", "profit", "order",
        "cost", "margin", "region", "channel", "quota", "deal", "pipeline",
    ),
    "inventory": (
        "inventory", "stock", "warehouse", "reorder", "lead_time", "supplier", "sku", "holding_cost", "turnover",
        "backorder", "logistics", "fulfillment",
    ),
    "hr": (
        "employee", "attrition", "salary", "department", "job_role", "tenure", "performance", "turnover", "satisfaction",
        "overtime", "leave", "bonus",
    ),
}

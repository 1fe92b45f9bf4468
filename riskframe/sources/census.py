"""Tasks on the public census microdata: labels and texts of columns, questions, thresholds.

Occupations, birthplaces, ancestries, languages, states and origins have codebooks, which are files to read with
tables.read_codebook() and join with valuemap.looked_up(); their paths are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.task import Choice, MultipleChoice, Numeric, Task
from ..operators.threshold import Threshold
from ..operators.valuemap import ColumnToText, composed

# Texts of codes, as the survey's documentation and the benchmark have them.
WORKER = {
    1: "Working for a for-profit private company or organization",
    2: "Working for a non-profit organization",
    3: "Working for the local government",
    4: "Working for the state government",
    5: "Working for the federal government",
    6: "Owner of non-incorporated business, professional practice, or farm",
    7: "Owner of incorporated business, professional practice, or farm",
    8: "Working without pay in a for-profit family business or farm",
    9: "Unemployed and last worked 5 years ago or earlier or never worked",
}
SCHOOLING = {
    1: "N/A - no schooling completed",
    2: "Nursery school / preschool",
    3: "Kindergarten",
    4: "1st grade only",
    5: "2nd grade",
    6: "3rd grade",
    7: "4th grade",
    8: "5th grade",
    9: "6th grade",
    10: "7th grade",
    11: "8th grade",
    12: "9th grade",
    13: "10th grade",
    14: "11th grade",
    15: "12th grade, no diploma",
    16: "Regular high school diploma",
    17: "GED or alternative credential",
    18: "Some college, less than 1 year",
    19: "Some college, 1 or more years, no degree",
    20: "Associate's degree",
    21: "Bachelor's degree",
    22: "Master's degree",
    23: "Professional degree beyond a bachelor's degree",
    24: "Doctorate degree",
}
MARRIAGE = {1: "Married", 2: "Widowed", 3: "Divorced", 4: "Separated", 5: "Never married"}
RELATIONSHIP = {
    0: "The reference person itself",
    1: "Husband/wife",
    2: "Biological son or daughter",
    3: "Adopted son or daughter",
    4: "Stepson or stepdaughter",
    5: "Brother or sister",
    6: "Father or mother",
    7: "Grandchild",
    8: "Parent-in-law",
    9: "Son-in-law or daughter-in-law",
    10: "Other relative",
    11: "Roomer or boarder",
    12: "Housemate or roommate",
    13: "Unmarried partner",
    14: "Foster child",
    15: "Other non-relative",
    16: "Institutionalized group quarters population",
    17: "Non-institutionalized group quarters population",
}
SEX = {1: "Male", 2: "Female"}
RACE = {
    1: "White",
    2: "Black or African American",
    3: "American Indian",
    4: "Alaska Native",
    5: "American Indian and Alaska Native tribes specified; or American Indian or Alaska Native, not specified and no other races",
    6: "Asian",
    7: "Native Hawaiian and Other Pacific Islander",
    8: "Some other race alone (non-White)",
    9: "Two or more races",
}
COVERAGE = {1: "Covered by public health insurance", 2: "Not covered by public health insurance"}
DISABILITY = {1: "With a disability", 2: "No disability"}
PARENTS_WORK = {
    1: "Living with two parents, both employed",
    2: "Living with two parents, only Father is employed",
    3: "Living with two parents, only Mother is employed",
    4: "Living with two parents, neither employed",
    5: "Living with Father, and Father is employed",
    6: "Living with Father, and Father is not employed",
    7: "Living with Mother, and Mother is employed",
    8: "Living with Mother, and Mother is not employed",
}
CITIZENSHIP = {
    1: "Born in the United States",
    2: "Born in Puerto Rico, Guam, the U.S. Virgin Islands, or the Northern Marianas",
    3: "Born abroad of American parents",
    4: "Naturalized US citizen",
    5: "Not a US citizen",
}
MOBILITY = {
    1: "Lived in the same house one year ago",
    2: "Lived in a different house, outside the United States and Puerto Rico, one year ago",
    3: "Lived in a different house in the United States one year ago",
}
MILITARY = {
    1: "Now on active duty",
    2: "On active duty in the past, but not now",
    3: "Only on active duty for training in Reserved/National Guard",
    4: "Never served in the military",
}
ANCESTRY = {1: "Single ancestry", 2: "Multiple ancestry", 3: "Unclassified", 4: "Not reported", 8: "N/A (information suppressed for certain area codes)"}
NATIVITY = {1: "Native", 2: "Foreign born"}
OTHER_LANGUAGE = {1: "Speaks a language other than English at home.", 2: "Speaks only English at home."}
ENGLISH = {1: "Very well", 2: "Well", 3: "Not well", 4: "Not at all"}
PARENTS_BIRTH = {
    1: "Living with both parents, both of whom are native",
    2: "Living with both parents, Father only is foreign born",
    3: "Living with both parents, Mother only is foreign born",
    4: "Living with both parents, both of whom are foreign born",
    5: "Living with Father only, who is native",
    6: "Living with Father only, who is foreign born",
    7: "Living with Mother only, who is native",
    8: "Living with Mother only, who is foreign born",
}
HEARING = {1: "With hearing difficulty", 2: "No hearing difficulty"}
VISION = {1: "With vision difficulty", 2: "No vision difficulty"}
COGNITION = {1: "With cognitive difficulty", 2: "No cognitive difficulty"}
EMPLOYMENT = {
    1: "Civilian employed, at work",
    2: "Civilian employed, with a job but not at work",
    3: "Unemployed",
    4: "Armed forces, at work",
    5: "Armed forces, with a job but not at work",
    6: "Not in labor force",
}
BIRTH_GIVEN = {1: "Person has given birth within the last year.", 2: "Person has not given birth within the last year."}
COMMUTE = {
    1: "Car, truck, or van",
    2: "Bus or trolley bus",
    3: "Streetcar or trolley car",
    4: "Subway or elevated",
    5: "Railroad",
    6: "Ferryboat",
    7: "Taxicab",
    8: "Motorcycle",
    9: "Bicycle",
    10: "Walked",
    11: "Worked at home",
    12: "Other method",
}
GRANDPARENTS = {1: "Household includes grandparent living with grandchildren", 2: "Household does not include grandparents living with grandchildren"}
INSURANCE = {
    1: "Person has purchased insurance directly from an insurance company",
    2: "Person has not purchased insurance directly from an insurance company (is either uninsured or insured through another source)",
}
# Coarser groups.
LOW_WORKER = composed({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 8, 9: 9}, {1: "Employed", 2: "Self-employed", 8: "Unpaid worker", 9: "Unemployed or not in the labor force"})
LOW_SCHOOLING = composed(
    {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 3, 7: 3, 8: 3, 9: 4, 10: 4, 11: 4, 12: 5, 13: 5, 14: 5, 15: 5, 16: 6, 17: 6, 18: 7, 19: 7, 20: 8, 21: 9, 22: 10, 23: 10, 24: 10},
    {
        1: "No formal education",
        2: "Early childhood education",
        3: "Primary education (Grades 1-5)",
        4: "Middle school education (Grades 6-8)",
        5: "Some high school, no diploma",
        6: "High school graduate or equivalent",
        7: "Some college, no degree",
        8: "Associate's degree",
        9: "Bachelor's degree",
        10: "Graduate or professional degree",
    },
)
LOW_RELATIONSHIP = composed(
    {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 10: 8, 11: 9, 12: 9, 13: 1, 14: 2, 15: 9, 16: 10, 17: 10},
    {
        0: "Reference person",
        1: "Spouse or partner",
        2: "Child (biological, adpoted or stepchild)",
        3: "Siblings",
        4: "Parent",
        5: "Grandchild",
        6: "Parent-in-law",
        7: "Son-in-law or daughter-in-law",
        8: "Other relative",
        9: "Non-relative (e.g., roommate, boarder)",
        10: "Group quarters population",
    },
)
LOW_RACE = composed(
    {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7},
    {1: "White", 2: "Black or African American", 3: "Indigenous (American Indian or Alaska Native)", 4: "Asian", 5: "Pacific Islander", 6: "Some other race alone", 7: "Two or more races"},
)
SECTORS = {
    "MGR": "Management Occupations",
    "BUS": "Business and Financial Operations",
    "FIN": "Finance and Accounting",
    "CMM": "Computer and Mathematical Occupations",
    "ENG": "Engineering and Architecture",
    "SCI": "Science and Research",
    "CMS": "Community and Social Services",
    "LGL": "Legal Occupations",
    "EDU": "Education and Training",
    "ENT": "Arts, Design, Entertainment, Sports, and Media",
    "MED": "Healthcare Practitioners and Technicians",
    "HLS": "Healthcare Support",
    "PRT": "Protective Services",
    "EAT": "Food Preparation and Serving",
    "CLN": "Building and Grounds Cleaning and Maintenance",
    "PRS": "Personal Care and Service",
    "SAL": "Sales and Related Occupations",
    "OFF": "Office and Administrative Support",
    "FFF": "Farming, Fishing, and Forestry",
    "CON": "Construction",
    "EXT": "Mining and Extraction",
    "RPR": "Installation, Maintenance, and Repair",
    "PRD": "Production and Manufacturing",
    "TRN": "Transportation and Material Moving",
    "MIL": "Military Occupations",
    "UNEMPL": "Unemployed, Not worked for at least 5 years or Never Worked",
}
#: Birthplace codes by world region; of equal claims the later line holds, all others are "Other/Unspecified".
BIRTHPLACES = [
    ("Northeast USA", [9, 23, 25, 33, 34, 36, 42, 44, 50]),
    ("Midwest USA", [17, 18, 19, 20, 26, 27, 29, 31, 38, 39, 46, 55]),
    ("South USA", [1, 5, 10, 11, 12, 13, 21, 22, 24, 28, 37, 40, 45, 47, 48, 51, 54]),
    ("West USA", [2, 4, 6, 8, 15, 16, 30, 32, 35, 41, 49, 53, 56]),
    ("US Territories", [60, 66, 69, 72, 78]),
    ("European Union", [102, 103, 104, 151, 208, 148, 106, 108, 109, 110, 116, 117, 119, 120, 156, 157, 126, 128, 129, 130, 132, 149, 134, 136]),
    ("Europe, non EU", [100, 105, 118, 127, 137, 138, 139, 140, 142, 147, 150, 152, 154, *range(158, 170)]),
    ("Asia", [*range(200, 208), *range(209, 250), 253, 254]),
    ("North America (excluding USA)", [300, 301, 303]),
    ("Central America & Caribbean", range(310, 345)),
    ("South America", range(360, 375)),
    ("Africa", [*range(400, 462), *range(463, 470)]),
    ("Oceania", range(501, 528)),
]


def low_birthplace(x: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for region, codes in BIRTHPLACES:
        out = out.when(x.cast("int").isin(list(codes)), region)
    return out.otherwise("Other/Unspecified")


def low_occupation(description: Column) -> Column:
    """From the codebook's text, with its prefix."""
    table = F.create_map(*[F.lit(v) for kv in SECTORS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, t.sector(description)), F.lit("N/A"))


LOW = {"AGEP": t.age_range, "COW": LOW_WORKER, "SCHL": LOW_SCHOOLING, "POBP": low_birthplace, "RELP": LOW_RELATIONSHIP, "WKHP": t.hours_range, "RAC1P": LOW_RACE}


def joined_text(name: str):
    """Of a column that looked_up() has already turned into text."""
    return lambda x: x.cast("string")


def _area(prefix: str):
    return lambda x: F.concat(F.lit(prefix), x.cast("int").cast("string"), F.lit("."))


#: Each column's label, its codes or format, and its text for missing values.
_C = ColumnToText
COLUMNS: dict[str, ColumnToText] = {
    c.name: c
    for c in (
        _C("AGEP", "age", t.years_old),
        _C("COW", "class of worker", WORKER),
        _C("SCHL", "highest educational attainment", SCHOOLING),
        _C("MAR", "marital status", MARRIAGE),
        _C("RELP", "relationship to the reference person in the survey", RELATIONSHIP),
        _C("WKHP", "usual number of hours worked per week", t.hours, "N/A (less than 16 years old, or did not work during the past 12 months)"),
        _C("SEX", "sex", SEX),
        _C("RAC1P", "race", RACE),
        _C("PINCP", "yearly income", t.dollars, "N/A (less than 15 years old)"),
        _C("PUBCOV", "public health coverage status", COVERAGE),
        _C("DIS", "disability status", DISABILITY),
        _C("ESP", "employment status of parents", PARENTS_WORK, "N/A (not own child of householder, and not child in subfamily)"),
        _C("CIT", "citizenship status", CITIZENSHIP),
        _C("MIG", "mobility status over the last year", MOBILITY),
        _C("MIL", "military service status", MILITARY, "N/A (less than 17 years old)"),
        _C("ANC", "ancestry", ANCESTRY),
        _C("NATIVITY", "nativity", NATIVITY),
        _C("LANX", "language other than English spoken at home", OTHER_LANGUAGE, "N/A (less than 5 years old)", value_only=True),
        _C("ENG", "ability to speak English", ENGLISH, "Native (speaks only English)"),
        _C("NOP", "nativity of parents", PARENTS_BIRTH, "N/A (not own child of householder and not child in subfamily)"),
        _C("DEAR", "hearing status", HEARING),
        _C("DEYE", "vision status", VISION),
        _C("DREM", "cognition status", COGNITION, "N/A (less than 5 years old)"),
        _C("ESR", "employment status", EMPLOYMENT, "N/A (less than 16 years old)"),
        _C("FER", "person has given birth within the last year", BIRTH_GIVEN, "N/A (less than 15 years old, or greater than 50 years old, or male)", value_only=True),
        _C("JWMNP", "commute time", t.minutes, "N/A (not a worker, or worker who worked at home)"),
        _C("JWTR", "means of transportation to work", COMMUTE),
        _C("POVPIP", "income-to-poverty ratio", t.poverty_ratio),
        _C("GCL", "grandparent living with grandchildren", GRANDPARENTS, "N/A (less than 30 years old, or living in institutional group quarters)", value_only=True),
        _C("PUMA", "Public Use Microdata Area (PUMA) code", _area("Public Use Microdata Area (PUMA) code: "), value_only=True),
        _C("POWPUMA", "place of work PUMA", _area("Public Use Microdata Area (PUMA) code for the place of work: "), value_only=True),
        _C("HINS2", "acquired health insurance directly from an insurance company", INSURANCE, value_only=True),
        # By codebook:
        _C("OCCP", "occupation", joined_text("OCCP")),
        _C("POBP", "place of birth", joined_text("POBP")),
        _C("ANC1P", "detailed ancestry", joined_text("ANC1P")),
        _C("LANP", "language spoken at home (other than English)", joined_text("LANP"), "N/A (speaks only English at home)"),
        _C("ST", "resident state", joined_text("ST")),
        _C("HISP", "Hispanic origin", joined_text("HISP")),
    )
}
#: How a codebook's texts are finished.
CODEBOOK_TEXT = {"OCCP": t.occupation, "POBP": t.before_slash, "ST": t.before_slash, "ANC1P": F.trim, "LANP": F.trim, "HISP": F.trim}


def _task(name: str, description: str, target: str, threshold: Threshold, features: str, choices: tuple[str, dict[str, int]], numeric: str | None) -> Task:
    column = threshold.name(target)
    return Task(
        name, description, tuple(features.split()), target, threshold, "RAC1P", COLUMNS,
        MultipleChoice(column, choices[0], tuple(Choice(text, v) for text, v in choices[1].items())),
        Numeric(column, numeric) if numeric else None,
    )


# Questions, choices and descriptions of the tasks. Feature lists are those of the public benchmark by Ding et al. (2021).
TASKS: dict[str, Task] = {
    x.name: x
    for x in (
        _task("ACSIncome", "predict whether an individual's income is above $50,000", "PINCP", Threshold(50000, ">"), "AGEP COW SCHL MAR OCCP POBP RELP WKHP SEX RAC1P", ("What is this person's estimated yearly income?", {"Below $50,000": 0, "Above $50,000": 1}), "What is the probability that this person's estimated yearly income is above $50,000 ?"),
        _task("ACSPublicCoverage", "predict whether an individual is covered by public health insurance", "PUBCOV", Threshold(1, "=="), "AGEP SCHL MAR SEX DIS ESP CIT MIG MIL ANC NATIVITY DEAR DEYE DREM PINCP ESR ST FER RAC1P", ("Does this person have public health insurance coverage?", {"Yes, person is covered by public health insurance": 1, "No, person is not covered by public health insurance": 0}), "What is the probability that this person is covered by public health insurance?"),
        _task("ACSMobility", "predict whether an individual had the same residential address one year ago", "MIG", Threshold(1, "!="), "AGEP SCHL MAR SEX DIS ESP CIT MIL ANC NATIVITY RELP DEAR DEYE DREM RAC1P GCL COW ESR WKHP JWMNP PINCP", ("Has this person moved in the last year?", {"No, person has lived in the same house for the last year": 0, "Yes, person has moved in the last year": 1}), "What is the probability that this person has moved in the last year?"),
        _task("ACSEmployment", "predict whether an individual is employed", "ESR", Threshold(1, "=="), "AGEP SCHL MAR RELP DIS ESP CIT MIG MIL ANC NATIVITY DEAR DEYE DREM SEX RAC1P", ("What is this person's employment status?", {"Employed civilian": 1, "Unemployed or in the military": 0}), "What is the probability that this person is an employed civilian?"),
        _task("ACSTravelTime", "predict whether an individual has a commute to work that is longer than 20 minutes", "JWMNP", Threshold(20, ">"), "AGEP SCHL MAR SEX DIS ESP MIG RELP RAC1P PUMA ST CIT OCCP JWTR POWPUMA POVPIP", ("What is this person's commute time?", {"Longer than 20 minutes": 1, "Less than 20 minutes": 0}), "What is the probability that this person's commute time is longer than 20 minutes?"),
        _task("ACSIncomePovertyRatio", "predict whether an individual's income-to-poverty ratio is below 2.5", "POVPIP", Threshold(250, "<"), "AGEP SCHL MAR SEX DIS ESP MIG CIT MIL ANC NATIVITY RELP DEAR DEYE DREM RAC1P GCL ESR OCCP WKHP", ("Is this person's income-to-poverty ratio below 2.5 ? That is, is this person's annual income below 2.5 times the poverty line income?", {"Yes, this person earns below 2.5 times the poverty line income": 1, "No, this person earns above 2.5 times the poverty line income.": 0}), None),
    )
}
_ALL = sorted({f for n in ("ACSIncome", "ACSPublicCoverage", "ACSMobility", "ACSEmployment", "ACSTravelTime") for f in TASKS[n].features})
TASKS["ACSHealthInsurance-test"] = _task("ACSHealthInsurance-test", "predict whether an individual has purchased health insurance directly from an insurance company (as opposed to being insured through an employer, Medicare, Medicaid, or any other source)", "HINS2", Threshold(1, "=="), " ".join(_ALL), ("Has this person purchased health insurance directly from an insurance company?", {"Yes, this person has health insurance through a private company": 1, "No, this person either has insurance through other means or is uninsured": 0}), "What is the probability that this person has purchased health insurance directly through a private company?")

#: Rows that tasks are about, by the same paper.
POPULATIONS = {
    "ACSIncome": "AGEP > 16 AND PINCP > 100 AND WKHP > 0 AND PWGTP >= 1",
    "ACSPublicCoverage": "AGEP < 65 AND PINCP <= 30000",
    "ACSMobility": "AGEP > 18 AND AGEP < 35",
    "ACSEmployment": "true",
    "ACSTravelTime": "AGEP > 16 AND PWGTP >= 1 AND ESR = 1",
    "ACSIncomePovertyRatio": "true",
    "ACSHealthInsurance-test": "true",
}

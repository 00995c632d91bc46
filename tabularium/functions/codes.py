"""Code sets, bands and label maps of the published tables."""

# These must equal the published classification exactly.

# age in 21 fine bands; the leading blank makes the labels sort
AGE_BANDS = [
    (0, 5, " 0- 5 jaar"),
    (6, 11, " 6-11 jaar"),
    (12, 14, "12-14 jaar"),
    (15, 17, "15-17 jaar"),
    (18, 19, "18-19 jaar"),
    (20, 24, "20-24 jaar"),
    (25, 29, "25-29 jaar"),
    (30, 34, "30-34 jaar"),
    (35, 39, "35-39 jaar"),
    (40, 44, "40-44 jaar"),
    (45, 49, "45-49 jaar"),
    (50, 54, "50-54 jaar"),
    (55, 59, "55-59 jaar"),
    (60, 64, "60-64 jaar"),
    (65, 69, "65-69 jaar"),
    (70, 74, "70-74 jaar"),
    (75, 79, "75-79 jaar"),
    (80, 84, "80-84 jaar"),
    (85, 89, "85-89 jaar"),
    (90, 94, "90-94 jaar"),
    (95, 120, "95+"),
]

# age in statistical bands
AGE_BANDS_STATISTICAL = [
    (0, 14, "0-14 jaar"),
    (15, 19, "15-19 jaar"),
    (20, 24, "20-24 jaar"),
    (25, 29, "25-29 jaar"),
    (30, 39, "30-39 jaar"),
    (40, 49, "40-49 jaar"),
    (50, 59, "50-59 jaar"),
    (60, 69, "60-69 jaar"),
    (70, 79, "70-79 jaar"),
    (80, 120, "80+"),
]

# age in the six bands of the week-time table
AGE_BANDS_WEEKTIME = [
    (0, 15, " 0-15"),
    (16, 17, "16-17"),
    (18, 24, "18-24"),
    (25, 34, "25-34"),
    (35, 49, "35-49"),
    (50, 120, "50+"),
]

AGE_UNKNOWN = 32760
UNKNOWN = "Onbekend"
UNKNOWN_MUNICIPALITY = 9999
MUNICIPALITY_WITHOUT_UNIT = 997
FIRST_YEAR_WITH_REGIONS = 1978

# accident severity
DAMAGE_ONLY = 5

# first year that the new event source is used
CUTOVER_YEAR = 1987

# casualty outcome
OUTCOMES = [
    ([0, 1, 2, 3, 4, 5], "Overleden"),
    ([6, 7, 8], "Naar ziekenhuis"),
    ([9, 10], "Licht letsel"),
]
INJURED = {"Naar ziekenhuis": "Letsel", "Licht letsel": "Letsel"}

# how an accident was reported
REPORT_FULL = "PV/Regset/KMM+"
REPORT_FULL_CODES = [1, 2, 6, 7]
REPORT_SHORT = "KMM"
REPORT_SHORT_CODES = [9]
REPORT_INSURER = "IM"
REPORT_INSURER_CODES = [10, 11]

# road authorities that the old source names separately
OLD_AUTHORITIES = {
    "Spoorwegen": "Overige instanties",
    "Staatsbosbeheer": "Overige instanties",
}

# transport modes of the old source in the classes of the new one
OLD_MODES = {
    "Snorfiets": "Bromfiets",
    "Overig vvm": "Overig",
    "Losse voorwerpen": "Overig",
    "Bomen": "Overig",
    "Overige obstakel": "Overig",
    "Motor/scooter": "Motor",
    "Lopen": "Voetganger",
    "Auto": "Auto/bestel",
    "Bestelauto": "Auto/bestel",
    "Vrachtauto": "Vrachtauto/bus",
    "Bus": "Vrachtauto/bus",
}

# label repairs
PROVINCE_REPAIRS = {"FryslÃ¢n": "Fryslân"}
RATE_PROVINCE_REPAIRS = {
    "FryslÃ¢n": "Fryslân",
    "Overyssel": "Overijssel",
    "Overyssel + Flevoland": "Overijssel + Flevoland",
}
DEATH_AGE_REPAIRS = {"0  t/m  4": " 0 t/m  4", "5  t/m  9": " 5 t/m  9"}

# codebook variables: number, name, label, English label, whether the code is a number, label repairs
VARIABLES = {
    "sex": (493, "geslacht", "Geslacht", "Sex", True, None),
    "sex_text": (493, None, "Geslacht", None, False, None),
    "province": (25, "provincie", "Provincie", None, True, PROVINCE_REPAIRS),
    "police_region": (305, "politie_regio", "Politieregio", None, True, PROVINCE_REPAIRS),
    "police_unit": (1655, "arrondissement", "Eenheid", None, True, None),
    "authority": (203, None, "Wegbeheerder", None, False, None),
    "mode": (551, None, "Vervoerswijze", None, False, None),
    "old_mode": (916, None, "Vervoerswijze", None, False, None),
    "death_age": (None, "leeftijd_4_75", "Leeftijdsklasse", None, True, None),
    "death_mode": (None, "vervoer2", "Vervoerswijze", "TransportMode", True, None),
    "rate_month": (419, "maand", "Maand", "Month", True, None),
    "rate_weekday": (200, "weekdag", "Weekdag", "Weekday", True, None),
    "rate_hour": (930, "uur_ivo2", "Tijdstip", "Time", True, None),
    "rate_province": (556, "prov_ivo", "Provincie", None, True, RATE_PROVINCE_REPAIRS),
    "rate_mode": (551, "vvm_ivo", "Vervoerswijze", "TransportMode", True, None),
    "rate_age": (929, "leeftijd_ivo2", "Leeftijd", "Agegroup", True, None),
    "rate_sex": (264, "sexe", "Geslacht", "Sex", True, None),
}

# registration rate tables: key column, codebook variable, first and last published year
RATE_TABLES = {
    "Maand": ("MAAND", "rate_month", 1996, None),
    "Dag": ("WEEKDAG", "rate_weekday", 1996, 2021),
    "Tijdstip": ("UUR_IVO2", "rate_hour", 2001, 2021),
    "Provincie": ("PROV_IVO", "rate_province", 1996, None),
    "Vervoerswijze": ("VVM_IVO", "rate_mode", 1996, None),
    "Leeftijd": ("LEEFTIJD_IVO2", "rate_age", 1996, None),
    "Geslacht": ("SEXE", "rate_sex", 1996, None),
}

# week-time table
WEEKTIME_MODES = [
    ([71], "Voetganger"),
    ([64, 66, 67], "Fietser"),
    ([31, 61, 62], "GTW"),
    ([1, 11, 21, 22, 23], "Motorvoertuig"),
    ([93, 94, 32760, 32761], "Onbekend"),
]
WEEKTIME_OPPONENTS = [
    ([71], "voetganger"),
    ([64, 66], "fietser"),
    ([1, 11, 21, 22, 23], "motorvoertuig"),
    ([32761], "geen"),
]
WEEKTIME_OUTCOMES = [
    ([0, 1, 2, 3, 4, 5], "Dood"),
    ([6, 7, 8], "NaarZH"),
    ([9, 10], "Licht"),
]
WEEKTIME_SEXES = [([1], "Man"), ([2], "Vrouw")]

# motorcycle study
STUDY_PROVINCE = "Zuid-Holland"
STUDY_TOWNS = [
    "'s-Gravenhage",
    "Delft",
    "Leidschendam-Voorburg",
    "Midden-Delfland",
    "Pijnacker-Nootdorp",
    "Rijswijk",
    "Wassenaar",
    "Westland",
    "Zoetermeer",
    "Alphen aan den Rijn",
    "Bodegraven-Reeuwijk",
    "Gouda",
    "Hillegom",
    "Kaag en Braassem",
    "Katwijk",
    "Krimpenerwaard",
    "Leiden",
    "Leiderdorp",
    "Lisse",
    "Nieuwkoop",
    "Noordwijk",
    "Oegstgeest",
    "Teylingen",
    "Voorschoten",
    "Waddinxveen",
    "Zoeterwoude",
    "Zuidplas",
]
STUDY_EXTRA_ACCIDENTS = ["20220126097"]
MOTOR_CODES = [31, 32, 33]
STUDY_OUTCOMES = [
    ([0, 1, 2, 3, 4, 5], "dood"),
    ([6, 7, 8], "naar ZH"),
    ([9, 10], "licht"),
]
STUDY_LOCATIONS = [([20], "Kruispunt"), ([21], "Wegvak")]
STUDY_MOTORS = [([31], "Motor"), ([32], "Motor 3wielen")]
STUDY_MODES = [
    ([31], "Motor"),
    ([1, 11], "Auto/bestel"),
    ([61, 62], "Brom/snor"),
    ([64, 66], "Fiets/Ebike"),
    ([65], "Scootm"),
    ([71], "Voetg"),
    ([93], "GeenPartij"),
    ([94], "Anders"),
]
STUDY_OPPONENTS = [
    ([31], "Motor"),
    ([1, 11], "Auto/bestel"),
    ([21, 22, 24, 41], "VraBusLandb"),
    ([61, 62], "Brom/snor"),
    ([64, 66], "Fiets/Ebike"),
    ([65], "Scootm"),
    ([71], "Voetg"),
    ([81, 83, 84, 85, 91], "Object/dier"),
    ([93, 94], "GeenPartij"),
    ([32761], "Geen"),
]

# table profile
SCHEMA_NAMES = {1: "dbo", 5: "Admin1", 6: "temp"}
TEMPORARY_SCHEMA = 6
TARGET_YEAR = -2000
TARGET_FIRST_YEARS = {"BAG_REGIO": 1970, "BAG_POLREG": 1993, "WEER": 1985}
FIXED_PERIODS = {"SARTRE_GORDEL": (1992, 2003)}
UNPROFILED = [
    "RIJBEWIJS-RATIO",
    "DODEN-VOERTUIGKM",
    "RISICO_SLACHTOFFERS",
    "RIJBEWIJS_B_NOVG",
    "RIJBEWIJS_NOVG_B_POP",
    "RIJBEWIJS_A_NOVG",
    "RIJBEWIJS_NOVG_A_POP",
    "SLACHTOFFERS_INWONERS",
    "BRON_WEGVAKGEOGRAFIE",
    "GIS_LIMBURG",
    "GIS_TDN",
    "RISICO_BESTUURDERS",
    "RISICO_BESTUURDER_LETSEL",
    "CBS_DOODSOORZ",
    "IRTAD",
    "ACTUELE_WEGENLIJST",
    "WERKELIJK_GEWOND_INWONERS",
    "IVO_OVG_VERVOER",
    "POLITIE",
    "TEST",
    "CBS_DOODSOORZ2",
    "CBS_DOODSOORZ3",
    "BRON_OBJECT_COPY",
    "BRON_ONGEVAL_COPY",
]

# data overview
UPDATE_FREQUENCIES = [
    (0, 0, "informatie"),
    (-1, -1, "stopgezet"),
    (30, 190, "semester"),
    (300, 370, "jaarlijks"),
]
LONGEST_YEARLY = 370
MULTI_YEAR_FREQUENCY = "na meerdere jaren"
OTHER_FREQUENCY = "anders"
INTERNATIONAL_HOLDERS = [
    "ETSC",
    "European Union",
    "Eurostat",
    "FERSI",
    "IHME",
    "IRF",
    "ITF",
    "NHTSA",
    "VIAS",
    "WHO",
]
HIDDEN_PREFIXES = ["T_"]
HIDDEN_MARKERS = ["TRANS_", "REF_", "RUW_", "RAW_", "TEST", "COPY", "_2017", "_2018", "_TableColumnsUsed"]
HIDDEN_MARKERS_ANY_CASE = ["BCK", "BACK", "_OUD", "_OLD", "OLD_", "NB01_"]
HIDDEN_MATRIX_TYPES = [2]

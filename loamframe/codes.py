"""Alias tables, null spellings, code lists and physical constants.

Everything in this file is a value that must be equal on every system that
exchanges data with this one; none of it is logic.
"""

# --- fixed values: canonical column names and their accepted aliases ---------
COLUMN_ALIASES = {
    "gid": ["id", "id_station", "station_id", "no", "identif"],
    "geometry": ["geom"],
    "datetime": ["acq_date", "date", "timestamp", "tifftag_datetime", "acquisition_date",
                 "date_maj", "an"],
    "file_url": [],
    "metadata": ["properties"],
    "bbox": [],
    "latitude": ["lat", "y"],
    "longitude": ["lon", "long", "longi", "x"],
    "description": ["desc", "reftyppar", "descr_sol"],
}

# --- fixed values: spellings of a missing attribute --------------------------
NULL_SPELLINGS = ["", "na", "Na", "NA", "n/a", "N/A"]

# --- fixed values: file kinds ------------------------------------------------
VECTOR_EXTENSIONS = [".shp", ".geojson", ".gpkg", ".gdb", ".csv"]
RASTER_EXTENSIONS = [".tif", ".tiff"]
INTERNAL_LAYERS = ["layer_styles", "qgis_projects"]
SYSTEM_LAYER_PATTERN = r"^N_\d+_\w+$"

# --- fixed values: coordinate systems by dataset name ------------------------
CSV_SOURCE_CRS = {
    "stations_hydrometriques": "EPSG:4326",
    "reseau_agrometeo": "EPSG:4326",
    "quebec_4326": "EPSG:4326",
    "quebec_32198": "EPSG:32198",
}
RASTER_TARGET_CRS = {"siigsol": "EPSG:32198"}

# --- fixed values: id and geometry roles, in priority order ------------------
ID_COLUMNS = ["gid", "id", "fid", "ogc_fid", "objectid"]
GEOMETRY_COLUMNS = ["geometry", "geom", "the_geom", "shape", "wkb_geometry"]

# --- fixed values: layer splitting -------------------------------------------
SPLIT_MAX_VERTICES = 100_000
SPLIT_MAX_DEPTH = 48
SPLIT_SOURCE_COLUMN = "split_source_gid"
SPLIT_PART_COLUMN = "split_part"

# --- fixed values: catalogue defaults ----------------------------------------
DEFAULT_DATETIME = "1950-01-01 00:00:00"

# --- fixed values: soil ------------------------------------------------------
HYDRO_GROUPS = ["A", "B", "C", "D", "A/D", "B/D", "C/D"]

# --- fixed values: scene classification classes hidden by the cloud mask -----
CLOUD_CLASSES = [3, 8, 9, 10]
REFLECTANCE_SCALE = 0.0001

# --- fixed values: region boxes (minx, miny, maxx, maxy) ---------------------
REGION_BOXES = {
    "estrie": (-72.5, 45.0, -71.0, 45.8),
    "montérégie": (-74.0, 45.0, -72.5, 45.7),
    "chaudière-appalaches": (-71.5, 45.8, -70.0, 46.8),
    "bas-saint-laurent": (-69.5, 47.0, -67.0, 48.5),
}

# --- fixed values: crop raster class -> crop group (classes not listed: AUT) -
CROP_GROUPS = {
    110: "FOI", 120: "AUT", 121: "AUT", 122: "FOI", 130: "AUT", 131: "AUT",
    132: "MUL", 133: "ORG", 134: "MUL", 135: "AUT", 136: "AVO", 137: "SEI", 138: "BPA",
    139: "BPA", 140: "BPA", 141: "FOI", 142: "AUT", 143: "AUT", 145: "BPA", 146: "BPA",
    147: "MGR", 148: "AUT", 149: "AUT", 150: "CNL", 151: "AUT", 152: "AUT", 153: "CNL",
    154: "AUT", 155: "AUT", 156: "AUT", 157: "AUT", 158: "SOY", 159: "AUT", 160: "PRT",
    161: "PRT", 162: "PRT", 163: "PRT", 167: "LDT", 168: "PRT", 174: "PRT", 175: "LDT",
    176: "LDT", 177: "PDT", 178: "LDT", 179: "LDT", 180: "FRU", 181: "PTF", 182: "PTF",
    183: "PTF", 185: "PTF", 188: "POM", 189: "FRU", 190: "FRU", 191: "AUT", 192: "AUT",
    193: "AUT", 194: "AUT", 195: "AUT", 196: "AUT", 197: "AUT", 198: "AUT", 199: "AUT",
}
DEFAULT_CROP_GROUP = "AUT"

# --- fixed values: gridded datasets (native = value * scale + offset) --------
GRID_VARIABLES = [
    # dataset, variable, native_name, scale, offset, units
    ("era5_land", "tasmin", "tasmin", 1.0, -273.15, "degC"),
    ("era5_land", "tasmax", "tasmax", 1.0, -273.15, "degC"),
    ("era5_land", "tas", "tas", 1.0, -273.15, "degC"),
    ("era5_land", "pr", "pr", 86400.0, 0.0, "mm/day"),
    ("cmip6_espo_g6_r2", "tasmin", "tasmin", 1.0, -273.15, "degC"),
    ("cmip6_espo_g6_r2", "tasmax", "tasmax", 1.0, -273.15, "degC"),
    ("cmip6_espo_g6_r2", "pr", "pr", 86400.0, 0.0, "mm/day"),
]
SCENARIOS = ["ssp245", "ssp370", "ssp585"]
# models that lack one of the scenarios
MODEL_SCENARIOS = {"EC-Earth3-CC": ["ssp245", "ssp585"], "NESM3": ["ssp245", "ssp585"]}
INDICATOR_VARIABLES = {
    "gdd": ["tasmin", "tasmax"],
    "frost_days": ["tasmin"],
    "heat_stress_days": ["tasmax"],
    "pr_total": ["pr"],
    "pr_days": ["pr"],
}

# --- fixed values: model feature names ---------------------------------------
SPECTRAL_INDICES = ["NDVI", "BSI", "SAVI", "NDMI", "CI", "OMI", "EVI", "SI", "RI", "CAI", "BI"]
TERRAIN_FEATURES = ["elevation_mean", "slope_mean", "aspect_mean"]
CLIMATE_FEATURES = ["BIO1_mean", "BIO12_mean"]

# --- fixed values: two-sided 97.5 % Student quantiles by degrees of freedom --
STUDENT_T_975 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306,
    9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120,
    17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064,
    25: 2.060, 26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045,
}

# --- physical constants ------------------------------------------------------
EARTH_RADIUS_M = 6_371_008.8         # mean radius, for distances
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
AUTHALIC_RADIUS_M = 6_371_007.180918  # sphere with the ellipsoid's surface
KM_PER_DEGREE = 111.32

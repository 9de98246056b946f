"""Fixed values of the energy-balance model, the data model and the classifier set-up."""

# --- Fixed values: column vocabulary -------------------------------------------------
BANDS = ["red", "green", "blue", "nir08", "swir16", "swir22", "lwir11"]
PARCEL_KEY = ["provincia", "municipio", "agregado", "zona", "poligono", "parcela", "recinto"]
ET_VARS = ["ET_inst", "ET24h", "LE", "EF", "NDVI", "NDWI"]
EXPORT_VARS = ["LE", "EF", "ET_inst", "ET24h"]
PLATFORMS = ["landsat-8", "landsat-9"]
IRRIGATED_CODE = "R"

# --- Fixed values: run parameters ----------------------------------------------------
MAX_CLOUD = 2.0
MIN_PIXELS = 3
CELL_SIZE_M = 50_000.0
PIXEL_SIZE_M = 30.0
DEM_SIZE_M = 60.0
FIXED_UREF = 3.5
WIND_HEIGHT_M = 10.0
WIND_GRID_DEG = 0.25
ELEVATION_STRIDE = 64

# --- Fixed values: physics -----------------------------------------------------------
SOLAR_CONSTANT = 1361.0
STEFAN_BOLTZMANN = 5.670374419e-8
LAPSE_RATE = 0.0065
AIR_HEAT = 1004.0
KARMAN = 0.41
GRAVITY = 9.81
DRY_AIR_GAS = 287.0
DIURNAL_FACTOR = 0.75
HALF_PI_STABILITY = 0.5 * 3.14159265
MOISTURE_DAMPING = 0.35

# --- Fixed values: hot / cold pixel choice and calibration ---------------------------
COLD_NDVI, COLD_NDWI, COLD_ALBEDO_LO, COLD_ALBEDO_HI = 0.7, 0.1, 0.08, 0.40
HOT_NDVI, HOT_NDWI = 0.2, 0.0
CALIBRATION_QUANTILES = {
    "Ts_hot": 0.98,
    "Ts_cold": 0.05,
    "Rn_hot": 0.90,
    "G_hot": 0.50,
    "rho_hot": 0.50,
    "rah_hot": 0.80,
}
STABILITY_PASSES = 7

# --- Fixed values: classifier --------------------------------------------------------
SEED = 42
FOLDS = 5
TEST_SHARE = 0.2
OVERFIT_GAP = 0.2
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]
FOREST_PARAMS = {"n_estimators": 300, "max_depth": 12, "min_samples_leaf": 2, "max_features": None}
FOREST_SPACE = {
    "n_estimators": [200, 300, 400],
    "max_depth": [3, 5, 8, 12],
    "min_samples_leaf": [1, 2, 5, 10, 20],
    "min_samples_split": [2, 5, 10, 20],
    "max_features": ["sqrt", "log2", 0.5, None],
}
SEARCH_CANDIDATES = 40
FITS_AT_ONCE = 8

"""SQL of the energy balance, stage by stage: each function maps a source to a SELECT."""


def clip(x, lo=None, hi=None):
    known, out = f"{x} IS NULL", f"{x}"
    if lo is not None:
        out = f"greatest({out}, {lo})"
        known += f" OR ({lo}) IS NULL"
    if hi is not None:
        out = f"least({out}, {hi})"
        known += f" OR ({hi}) IS NULL"
    return f"CASE WHEN {known} THEN NULL ELSE {out} END"


def indices(src):
    nd = lambda a, b: f"({a} - {b}) / nullif({a} + {b}, 0)"
    one = f"""SELECT *, {clip(nd('nir08', 'red'), '-1.0', '1.0')} AS NDVI,
      {clip('1.5 * (nir08 - red) / nullif(0.5 + nir08 + red, 0)', '-1.0', '1.0')} AS SAVI,
      {clip(nd('green', 'nir08'), '-1.0', '1.0')} AS NDWI, {nd('nir08', 'swir16')} AS NDMI,
      0.4739 * blue + -0.4372 * green + 0.1652 * red + 0.2831 * nir08 + 0.1072 * swir16 + 0.1029 * swir22 + 0.0366 AS albedo
      FROM {src}"""
    two = f"""SELECT *, {clip('-(ln(greatest(0.69 - SAVI, 1e-6)) / 0.59) / 0.91', '0.0', '7.0')} AS LAI FROM ({one})"""
    return f"""SELECT *, {clip('0.95 + 0.01 * LAI', '0.95', '0.99')} AS e_0 FROM ({two})"""


def radiation(src):
    """Needs dem, slope, aspect, elv_ref, sun_elevation, sun_azimuth."""
    a = f"SELECT *, radians(90.0 - sun_elevation) AS zen, radians(sun_azimuth) - aspect AS dg FROM {src}"
    b = f"""SELECT *, cos(zen) * cos(slope) + sin(zen) * sin(slope) * cos(dg) AS cos_i,
      {clip('0.75 + 2.0e-5 * dem', '0.55', '0.90')} AS tau FROM ({a})"""
    c = f"""SELECT *, tau * (1361.0 * greatest(cos(zen), 0.0) * (cos_i / greatest(cos(zen), 1e-6))) AS Rs_cs,
      lwir11 + 0.0065 * (elv_ref - dem) AS LSTk_demcorr FROM ({b})"""
    d = f"""SELECT *, (1.0 - albedo) * Rs_cs AS Rns, LSTk_demcorr AS Ta,
      e_0 * 5.670374419e-8 * pow(LSTk_demcorr, 4.0) AS L_up,
      {clip('0.72 + 1.6e-3 * (LSTk_demcorr - 273.15)', '0.72', '0.95')} * 5.670374419e-8 * pow(LSTk_demcorr, 4.0) AS L_down
      FROM ({c})"""
    d = d.replace("CASE WHEN 0.72", "(CASE WHEN 0.72").replace("END * 5.67", "END) * 5.67")
    return f"SELECT *, Rns + (L_down - L_up) AS Rn FROM ({d})"


def cover(src):
    span = clip("(NDVI - ndvi_p05) / greatest(ndvi_p95 - ndvi_p05, 1e-6)", "0.0", "1.0")
    return f"SELECT * EXCLUDE (f0), f0 * f0 AS fc FROM (SELECT *, {span} AS f0 FROM {src})"


def soil(src):
    a = f"""SELECT *,
      Rn * (({clip('LSTk_demcorr - 273.15', '0.0', '30.0')}) * (0.0038 + 0.006 * albedo) * (1.0 - 0.995 * pow(NDVI, 4.0))) AS gs,
      Rn * ({clip('0.05 + 0.18 * exp(-0.521 * LAI)', '0.02', '0.35')}) AS gl,
      ({clip('0.24 + 0.18 * albedo', '0.20', '0.40')}) * Rn AS gb,
      ({clip('0.05 + 0.02 * exp(-0.7 * LAI)', '0.03', '0.12')}) * Rn AS gv FROM {src}"""
    b = f"SELECT *, CASE WHEN fc >= 0.15 THEN 0.5 * (gs + gl) ELSE gb * (1.0 - fc) + gv * fc END AS g00 FROM ({a})"
    return f"SELECT *, {clip('g00', '0.0', 'Rn * 0.6')} AS G0 FROM ({b})"


def damping(src):
    m = clip("(NDMI - ndmi_p05) / greatest(ndmi_p95 - ndmi_p05, 1e-6)", "0.0", "1.0")
    a = f"SELECT *, G0 * (1.0 - 0.35 * ({m})) AS g1 FROM {src}"
    return f"SELECT *, {clip('g1', '0.0', 'Rn * 0.6')} AS G FROM ({a})"


def roughness(src):
    a = f"""SELECT *, 0.67 * ({clip('0.1 + 2.0 * fc', '0.05', '3.0')}) AS disp,
      {clip('exp(5.62 * SAVI - 5.809)', '0.005', '0.5')} AS z0m FROM {src}"""
    b = f"""SELECT *, ln(greatest(zref - disp, 0.05) / greatest(z0m, 1e-6)) AS pu,
      ln(greatest(2.0 - disp, 0.05) / greatest(0.1 - disp, 0.02)) AS ph FROM ({a})"""
    c = f"SELECT *, {clip('0.41 * Uref / nullif(pu, 0)', '0.05', '2.0')} AS ustar0 FROM ({b})"
    return f"SELECT *, {clip('ph / (0.41 * ustar0)', '20.0', '200.0')} AS rah0 FROM ({c})"


def air(src):
    a = f"SELECT *, 101325.0 * pow(greatest(1.0 - 2.25577e-5 * dem, 1e-6), 5.2559) AS p_air FROM {src}"
    return f"SELECT *, p_air / nullif(287.0 * Ta, 0) AS rho FROM ({a})"


def fluxes(src):
    return air(f"({roughness(f'({damping(f"({soil(f'({cover(src)})')})")})')})")


HOT = "(LSTk_demcorr IS NOT NULL AND NDVI <= 0.2 AND NDWI < 0.0)"
COLD = "(LSTk_demcorr IS NOT NULL AND NDVI >= 0.7 AND NDWI < 0.1 AND albedo >= 0.08 AND albedo <= 0.40)"


def nearest(keys, name, expr, q, src, where="TRUE"):
    """Exact nearest quantile per group, rank round-half-even(q * (n - 1))."""
    k = ", ".join(keys)
    return f"""SELECT {k}, max(v) FILTER (rn - 1 = round_even({q} * (n - 1), 0)) AS {name} FROM (
      SELECT {k}, {expr} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {expr}) AS rn,
        CAST(count(*) OVER (PARTITION BY {k}) AS DOUBLE) AS n
      FROM {src} WHERE ({where}) AND ({expr}) IS NOT NULL) GROUP BY {k}"""


def joined_scalars(keys, parts, base):
    """Left join of several per-scene queries onto the distinct scenes of `base`."""
    k = ", ".join(keys)
    out = f"(SELECT DISTINCT {k} FROM {base}) s"
    for i, p in enumerate(parts):
        out += f" LEFT JOIN ({p}) p{i} USING ({k})"
    return f"SELECT * FROM {out}"


def line(src, tag):
    a = f"SELECT *, greatest(Rn_hot - G_hot, 0.0) AS hh FROM {src}"
    raw = f"hh * rah_hot_{tag} / nullif(rho_hot * 1004.0, 0)"
    b = f"SELECT *, CASE WHEN hh > 10 AND rah_hot_{tag} IS NOT NULL THEN {clip(raw, '5.0', '25.0')} END AS dT_hot_{tag} FROM ({a})"
    c = f"""SELECT *, CASE WHEN dT_hot_{tag} IS NOT NULL AND abs(Ts_hot - Ts_cold) >= 0.2
      THEN (dT_hot_{tag} - 0.5) / (Ts_hot - Ts_cold) END AS a_{tag} FROM ({b})"""
    return f"SELECT * EXCLUDE (hh), 0.5 - a_{tag} * Ts_cold AS b_{tag} FROM ({c})"


def psi(src, length="L"):
    x = lambda z: f"CASE WHEN {length} < 0 THEN pow(1.0 - 16.0 * ({z} / {length}), 0.25) END"
    st = lambda z: f"WHEN {length} > 0 THEN -5.0 * ({z} / {length}) ELSE 0.0 END"
    heat = lambda x: f"2.0 * ln((1.0 + {x} * {x}) / 2.0)"
    a = f"SELECT *, {x('200.0')} AS xa, {x('2.0')} AS xb, {x('0.01')} AS xc FROM {src}"
    mom = "2.0 * ln((1.0 + xa) / 2.0) + ln((1.0 + xa * xa) / 2.0) - 2.0 * atan(xa) + 0.5 * 3.14159265"
    return f"""SELECT * EXCLUDE (xa, xb, xc), CASE WHEN {length} < 0 THEN {mom} {st('200.0')} AS psi_m200,
      CASE WHEN {length} < 0 THEN {heat('xb')} {st('2.0')} AS psi_h2,
      CASE WHEN {length} < 0 THEN {heat('xc')} {st('0.01')} AS psi_h01 FROM ({a})"""


def floored(src):
    return f"SELECT * EXCLUDE (L0), CASE WHEN abs(L0) < 1.0 THEN sign(L0) ELSE L0 END AS L FROM {src}"


def one_pass(src, tag):
    a = f"SELECT * REPLACE (coalesce(a_{tag} * LSTk_demcorr + b_{tag}, dT) AS dT) FROM {src}"
    b = f"SELECT *, rho * 1004.0 * dT / nullif(CASE WHEN rah > 1e-3 THEN rah END, 0) AS h1 FROM ({a})"
    c = f"SELECT *, -1.0 * (rho * 1004.0 * pow(ustar, 3.0) * LSTk_demcorr / nullif(0.41 * 9.81 * h1, 0)) AS L0 FROM ({b})"
    d = psi(f"({floored(f'({c})')})")
    e = f"SELECT *, ln(zref / z0m) - psi_m200 AS den FROM ({d})"
    g = "CASE WHEN abs(den) < 1e-3 THEN CASE WHEN den >= 0 THEN 1e-3 ELSE -1e-3 END ELSE den END"
    f = f"SELECT * REPLACE (Uref * 0.41 / ({g}) AS ustar) FROM ({e})"
    r = clip("(ln(20.0) - psi_h2 + psi_h01) / nullif(ustar * 0.41, 0)", "10.0", "500.0")
    return f"SELECT * EXCLUDE (h1, L, den, psi_m200, psi_h2, psi_h01) REPLACE ({r} AS rah) FROM ({f})"


def sensible(src):
    raw = "rho * 1004.0 * dT / nullif(CASE WHEN rah > 1e-3 THEN rah END, 0)"
    return f"""SELECT *, CASE WHEN Rn - G > 0 THEN {clip(raw, '0.0', '(Rn - G) * 0.98')} ELSE 0.0 END AS H FROM {src}"""


def et(src):
    a = f"SELECT *, {clip('Rn - G - greatest(H, 0.0)', '0.0')} AS LE FROM {src}"
    a = a.replace("CASE WHEN Rn - G - greatest(H, 0.0) IS NULL", "CASE WHEN Rn - G - H IS NULL")
    ef = clip("LE / CASE WHEN Rn - G > 0 THEN Rn - G END", "0.0", "1.0")
    return f"""SELECT *, 0.0036 * (LE / nullif(2.501 - 0.002361 * (lwir11 - 273.15), 0)) AS ET_inst, {ef} AS EF,
      LE * daylength * 0.75 / nullif(2.501e6 - 2361.0 * (lwir11 - 273.15), 0) AS ET24h FROM ({a})"""

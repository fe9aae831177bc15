"""Scalar weather and energy formulas as column expressions (all inside generated code, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_RADIUS, NM_RADIUS = 6371.0, 3440.065


def vapour_pressure_bolton(t_kelvin: Column, *, pascal: bool = True) -> Column:
    """Saturation vapour pressure after Bolton, in Pa or hPa."""
    return F.lit(611.2 if pascal else 6.112) * F.exp(17.67 * (t_kelvin - 273.15) / (t_kelvin - 29.65))


def vapour_pressure_tetens(t_celsius: Column) -> Column:
    """Saturation vapour pressure after Tetens, kPa."""
    return 0.6108 * F.exp(17.27 * t_celsius / (t_celsius + 237.3))


def vapour_deficit(t_celsius: Column, e: Column) -> Column:
    """Vapour pressure deficit, kPa, never negative."""
    return F.greatest(vapour_pressure_tetens(t_celsius) - e, F.lit(0.0))


def vapour_pressure(q: Column, p: Column) -> Column:
    """Vapour pressure from specific humidity and pressure, in the pressure's unit."""
    return q * p / (0.622 + 0.378 * q)


def relative_humidity(e: Column, es: Column, low: float = 1.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), 100.0 * e / es))


def hot_dry_windy(es_hpa: Column, e_hpa: Column, wind: Column) -> Column:
    return F.greatest(es_hpa - e_hpa, F.lit(0.0)) * wind


def wet_bulb_stull(t_celsius: Column, rh: Column) -> Column:
    """Wet-bulb temperature, Stull's closed form (rh in percent)."""
    return (
        t_celsius * F.atan(0.151977 * F.pow(rh + 8.313659, F.lit(0.5)))
        + F.atan(t_celsius + rh)
        - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh)
        - 4.686035
    )


def theta_e_bolton(t_kelvin: Column, p_hpa: Column, q: Column) -> Column:
    """Equivalent potential temperature after Bolton; humidity is clipped away from 0."""
    q = F.greatest(q, F.lit(1e-8))
    r = q / (1 - q)
    e = p_hpa * r / (0.622 + r)
    t_lcl = 2840.0 / (3.5 * F.log(t_kelvin) - F.log(e) - 4.805) + 55.0
    theta = t_kelvin * F.pow(1000.0 / p_hpa, 0.2854 * (1 - 0.28 * r))
    return theta * F.exp((3.376 / t_lcl - 0.00254) * 1000.0 * r * (1 + 0.81 * r))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = KM_RADIUS) -> Column:
    """Haversine distance of points in degrees."""
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(d_lat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def direction(u: Column, v: Column) -> Column:
    return F.degrees(F.atan2(v, u))


def circular_difference(a: Column, b: Column) -> Column:
    """a - b in degrees, from -180 up to but not including 180."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def wind_power_law(v: Column, hub: Column, *, base: float = 10.0, exponent: float = 0.14) -> Column:
    return v * F.pow(hub / base, F.lit(exponent))


def storm_wind_at(v_max: Column, radius: Column, distance: Column, *, core: float = 25.0, edge: float = 34.0, exponent: float = 0.6) -> Column:
    """Wind at a distance: v_max inside the core, falling to the edge wind at the radius; null beyond it."""
    inside = edge + (v_max - edge) * F.pow((radius - distance) / (radius - core), F.lit(exponent))
    return F.when(distance <= core, v_max).when(distance <= radius, inside)


def interpolate_knots(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through the knots, ends held."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(F.lit(knots[-1][1]))


def dose_with_floor(x: Column, knots: list[tuple[float, float]], floor: float) -> Column:
    return F.when(x < floor, F.lit(0.0)).otherwise(interpolate_knots(x, knots))


def rescaled_share(share_percent: Column, ratio: Column) -> Column:
    """A share after its part grows by a ratio: 100 B r / (1 + B (r - 1))."""
    b = share_percent / 100.0
    return 100.0 * b * ratio / (1 + b * (ratio - 1))


def _harmonic(g: Column, terms: list[tuple[float, str, int]]) -> Column:
    return sum((c * (F.cos(k * g) if f == "cos" else F.sin(k * g)) for c, f, k in terms), F.lit(0.0))


#: Spencer's Fourier series of the sun's position by the year's angle (fixed values): equation of time and declination, both in radians.
TIME_TERMS = [(0.001868, "cos", 1), (-0.032077, "sin", 1), (-0.014615, "cos", 2), (-0.040849, "sin", 2)]
DECLINATION_TERMS = [(-0.399912, "cos", 1), (0.070257, "sin", 1), (-0.006758, "cos", 2), (0.000907, "sin", 2), (-0.002697, "cos", 3), (0.00148, "sin", 3)]


def sun(day_of_year: Column, hour_utc: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """Equation of time (minutes), declination (radians) and cosine of the zenith angle.

    By the series of J. W. Spencer, Fourier series representation of the position of the sun, Search 2 (5), 1971; 229.18 minutes are a radian.
    """
    g = 2 * 3.141592653589793 / 365.0 * (day_of_year - 1 + (hour_utc - 12) / 24.0)
    eot = 229.18 * (0.000075 + _harmonic(g, TIME_TERMS))
    decl = 0.006918 + _harmonic(g, DECLINATION_TERMS)
    angle = F.radians((hour_utc * 60.0 + eot + 4.0 * lon) / 4.0 - 180.0)
    phi = F.radians(lat)
    cosine = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle)
    return {"eot": eot, "declination": decl, "cos_zenith": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))}


#: Polynomials of the clearness index up to 0.6 and beyond (fixed values): a, b, c of the beam's transmittance, and the clear sky's of the air mass.
BEAM = {
    "a": ([0.512, -1.560, 2.286, -2.222], [-5.743, 21.77, -27.49, 11.56]),
    "b": ([0.370, 0.962], [41.40, -118.5, 66.05, 31.90]),
    "c": ([-0.280, 0.932, -2.048], [-47.01, 184.2, -222.0, 73.81]),
}
CLEAR = [0.866, -0.122, 0.0121, -0.000653, 0.000014]


def polynomial(x: Column, terms: list[float]) -> Column:
    out = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        out = out * x + c
    return out


def direct_normal(ghi: Column, cos_zenith: Column, day_of_year: Column, pressure_hpa: Column) -> Column:
    """Direct normal irradiance from global irradiance by E. L. Maxwell, A quasi-physical model, SERI/TR-215-3087, 1987 (DISC).

    Air mass by F. Kasten, A new table and approximation formula for the relative optical air mass, 1965. Clearness index against the distance-corrected solar constant; relative air mass, corrected
    for pressure, at most 12; 0 from a zenith angle of 87 degrees on and without irradiance.
    """
    zenith = F.degrees(F.acos(cos_zenith))
    cosine = F.greatest(cos_zenith, F.lit(0.0))
    above = 1370.0 * (1.0 + 0.033 * F.cos(F.radians(360.0 * day_of_year / 365.0)))
    kt = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ghi / F.greatest(above * cosine, F.lit(1e-6))))
    mass = 1.0 / F.greatest(cosine + 0.15 * F.pow(F.greatest(93.885 - zenith, F.lit(1e-3)), F.lit(-1.253)), F.lit(1e-6))
    mass = F.greatest(F.lit(0.0), F.least(F.lit(12.0), mass * pressure_hpa / 1013.25))
    a, b, c = (F.when(kt <= 0.6, polynomial(kt, low)).otherwise(polynomial(kt, high)) for low, high in BEAM.values())
    beam = F.greatest(polynomial(mass, CLEAR) - (a + b * F.exp(c * mass)), F.lit(0.0)) * above
    return F.when((zenith < 87.0) & (ghi > 0) & (cos_zenith > 0), F.greatest(F.lit(0.0), F.least(F.lit(1400.0), beam))).otherwise(F.lit(0.0))


def corrected_irradiance(ghi: Column, cos_zenith: Column, ratio: Column, *, solar: float = 1361.0, cap: float = 1.2, day_cosine: float = 0.15) -> Column:
    """Irradiance whose clearness index is multiplied by a ratio and clipped to 0..cap, by day; as it is by night."""
    kt = F.greatest(F.lit(0.0), F.least(F.lit(cap), ghi / (solar * cos_zenith) * ratio))
    return F.when(cos_zenith > day_cosine, kt * solar * cos_zenith).otherwise(ghi)


def scaled_clearness(ghi: Column, cos_zenith: Column, factor: Column, *, solar: float = 1361.0, cap: float = 1.2) -> Column:
    """Clearness index times a factor, clipped, by day only."""
    return F.when(cos_zenith > 0, F.least(F.lit(cap), factor * ghi / (solar * cos_zenith)))


def combined_removal(a: Column, b: Column, cap: float) -> Column:
    """Two independent removals: 1 - (1 - a)(1 - b), capped."""
    return F.least(F.lit(cap), 1 - (1 - a) * (1 - b))


def quadrant(d_lat: Column, d_lon: Column, lat: Column) -> Column:
    """NE, SE, SW or NW by the signs of dy and dx scaled by the latitude's cosine."""
    dx = d_lon * F.cos(F.radians(lat))
    return F.when((d_lat >= 0) & (dx >= 0), "NE").when((d_lat < 0) & (dx >= 0), "SE").when(d_lat < 0, "SW").otherwise("NW")


def column_integral(q: Column, p: Column, *, g: float = 9.80665) -> Column:
    """Trapezoid of q over pressure levels / g, for two arrays of one length (levels from the bottom)."""
    n = F.size(q)
    steps = F.transform(
        F.sequence(F.lit(1), n - 1), lambda i: (F.get(q, i) + F.get(q, i - 1)) / 2 * (F.get(p, i - 1) - F.get(p, i))
    )
    return F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / g).otherwise(F.lit(0.0))


def at_level(values: Column, levels: Column, target: Column) -> Column:
    """Linear interpolation at a height between rising levels: first level's value below it, null above the last."""
    above = F.array_position(F.transform(levels, lambda z: z >= target), True).cast("int")
    i = above - 1
    z0, z1, v0, v1 = F.get(levels, i - 1), F.get(levels, i), F.get(values, i - 1), F.get(values, i)
    return F.when(above == 0, None).when(above == 1, F.get(values, F.lit(0))).otherwise(v0 + (v1 - v0) * (target - z0) / (z1 - z0))


def on_curve(x: Column, xs: Column, ys: Column) -> Column:
    """Interpolation on a per-row curve of rising points, ends held."""
    above = F.array_position(F.transform(xs, lambda a: a >= x), True).cast("int")
    i = above - 1
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return F.when(above == 0, F.element_at(ys, -1)).when(above == 1, F.get(ys, F.lit(0))).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

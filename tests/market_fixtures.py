"""Published quotes by curve and date, and one stored curve.

Each quote line is tenor:rate; the block name is the instrument type.
"""

OIS_2020_01_31 = {
    "OverNight": "1D:0.016 2D:0.016",
    "Cash": (
        "1W:0.01586 2W:0.015895 3W:0.01587 1M:0.01589 2M:0.01569 3M:0.01551 4M:0.01525 5M:0.01496 "
        "6M:0.01474 7M:0.0145 8M:0.01425 9M:0.01402 10M:0.0138 11M:0.01356 1Y:0.01333"
    ),
    "Bond": (
        "15M:0.012775 18M:0.01234 21M:0.01291 2Y:0.011712 3Y:0.01114 4Y:0.01099 5Y:0.01105 6Y:0.01124 "
        "7Y:0.01148 8Y:0.011788 9Y:0.01206 10Y:0.01235 12Y:0.01294 15Y:0.013565 20Y:0.01423 25Y:0.01444 "
        "30Y:0.01453 40Y:0.0141"
    ),
}

OIS_2020_05_27 = {  # percent
    "OverNight": "1D:0.05 2D:0.05",
    "Cash": (
        "1W:0.05395 2W:0.05375 1M:0.052 2M:0.052 3M:0.0535 4M:0.05175 5M:0.049 6M:0.0463 7M:0.04445 "
        "8M:0.04235 9M:0.0408 10M:0.039 11M:0.037 1Y:0.0347 18M:0.021"
    ),
    "Bond": (
        "2Y:0.01715 3Y:0.03275 4Y:0.074 5Y:0.13 6Y:0.197 7Y:0.258 8Y:0.314 9Y:0.367 10Y:0.414 12Y:0.498 "
        "15Y:0.579 20Y:0.663 25Y:0.69 30Y:0.705"
    ),
}

CAMARA_2020_05_27 = {  # percent
    "OverNight": "1D:0.5 2D:0.5",
    "Cash": "3M:0.48 6M:0.48 9M:0.48 1Y:0.5 18M:0.57",
    "Bond": (
        "2Y:0.63 3Y:0.79 4Y:0.99 5Y:1.27 6Y:1.52 7Y:1.72 8Y:1.88 9Y:2.04 10Y:2.15 12Y:2.23 15Y:2.32 "
        "20Y:2.32 30Y:2.48"
    ),
}

CAMARA_2020_04_02 = {  # percent
    "OverNight": "1D:0.5 2D:0.5",
    "Cash": "3M:0.51 6M:0.5275 9M:0.53 1Y:0.5675 18M:0.72",
    "Bond": (
        "2Y:0.865 3Y:1.105 4Y:1.4275 5Y:1.765 6Y:2.005 7Y:2.275 8Y:2.46 9Y:2.625 10Y:2.7425 12Y:2.83 "
        "15Y:2.93 20Y:2.945"
    ),
}

EONIA_2020_05_19 = {  # percent
    "OverNight": "1D:-0.458 2D:-0.458",
    "Cash": (
        "1W:-0.457 2W:-0.456 1M:-0.458 2M:-0.461 3M:-0.4673 4M:-0.4706 5M:-0.476 6M:-0.48 7M:-0.4827 "
        "8M:-0.486 9M:-0.488 10M:-0.49 11M:-0.492 1Y:-0.493"
    ),
    "Bond": (
        "18M:-0.505 2Y:-0.512 3Y:-0.511 4Y:-0.4951 5Y:-0.477 6Y:-0.4507 7Y:-0.4192 8Y:-0.3832 9Y:-0.346 "
        "10Y:-0.3063 11Y:-0.27 12Y:-0.2325 15Y:-0.143 20Y:-0.0865 25Y:-0.1045 30Y:-0.149 40Y:-0.24 50Y:-0.324"
    ),
}

GOVERNMENT_2020_01_31 = {  # percent
    "OverNight": "1D:3.587956841",
    "Cash": "28D:3.592788551 56D:3.597808379 91D:3.604096317",
    "Bond": (
        "182D:3.636482128 364D:3.661611722 728D:3.454945055 1092D:3.313714286 1456D:3.223364486 "
        "1820D:3.189345794 2184D:3.163205128 2548D:3.186538462 2912D:3.209871795 3276D:3.230981162 "
        "3640D:3.238124019 4550D:3.255981162 5460D:3.273838305 6370D:3.286549451 7280D:3.296549451 "
        "8190D:3.297271062 9100D:3.293104396 10920D:3.297843407 11830D:3.304093407"
    ),
}

LIBOR_2020_05_27 = {  # percent
    "OverNight": "ON:0.06163 TN:0.18",
    "Cash": "3M:0.3625",
    "Future": "ED1:0.31375 ED2:0.2875 ED3:0.3075 ED4:0.2275 ED5:0.2075 ED6:0.2125 ED7:0.2425",
    "Swap": (
        "2Y:0.265 3Y:0.27795 4Y:0.31955 5Y:0.37725 6Y:0.4426 7Y:0.50475 8Y:0.56325 9Y:0.6157 10Y:0.6643 "
        "11Y:0.7091 12Y:0.74935 15Y:0.83295 20Y:0.9157 30Y:0.95975"
    ),
}

LIBOR_2020_01_31 = {
    "OverNight": "1D:0.0154388 2D:0.01625",
    "Cash": "3M:0.0176325",
    "Future": "ED1:0.01855 ED2:0.01865 ED3:0.01875 ED4:0.0164 ED5:0.01505 ED6:0.0138",
    "Swap": (
        "2Y:0.013783 3Y:0.013211 4Y:0.013077 5Y:0.013167 6Y:0.01337 7Y:0.013621 8Y:0.01391 9Y:0.014222 "
        "10Y:0.014525 11Y:0.015106 12Y:0.015737 15Y:0.01619 20Y:0.016387 25Y:0.016627 30Y:0.01669 "
        "40Y:0.016294 50Y:0.01573"
    ),
}

# Stored today-basis curve of OIS_2020_01_31: days:factor. The 11-day value is known to be wrong.
OIS_CURVE_2020_01_31 = (
    "3:0.999866684 4:0.999822248 11:0.999337958 18:0.999204601 25:0.998897519 33:0.998544084 "
    "66:0.997127842 94:0.995960411 125:0.994723599 157:0.99350554 186:0.992426794 217:0.991317569 "
    "248:0.990258006 278:0.98926601 308:0.988305198 339:0.987363368 370:0.986453663 459:0.983902845 "
    "551:0.981357912 643:0.977306963 735:0.976480961 1102:0.966643131 1466:0.95646158 1831:0.945630507 "
    "2196:0.934054119 2561:0.92191919 2926:0.908965406 3293:0.895854859 3657:0.882336878 4387:0.854128813 "
    "5484:0.812927574 7311:0.747906674 9138:0.691869668 10962:0.641273293 14614:0.566176788"
)


def quote_rows(curve_id, val_date, blocks, scale=1.0):
    """Rows (curve_id, val_date, pos, tenor, type_rate, rate, is_missing)."""
    flat = [(kind, *item.split(":")) for kind, line in blocks.items() for item in line.split()]
    return [
        (curve_id, val_date, pos, tenor, kind, float(rate) / scale, False)
        for pos, (kind, tenor, rate) in enumerate(flat, start=1)
    ]

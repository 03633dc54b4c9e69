"""Published nine-wave results (fixed values) that the summaries must reproduce."""

WAVES = tuple(range(2015, 2024))

# Analytic rows and positives per wave.
N_TOTAL = {2015: 20519, 2016: 20455, 2017: 20676, 2018: 20974, 2019: 20579, 2020: 12458, 2021: 20367, 2022: 21119, 2023: 19810}
N_POSITIVE = {2015: 882, 2016: 862, 2017: 1058, 2018: 1123, 2019: 1312, 2020: 686, 2021: 1143, 2022: 1384, 2023: 1301}

# AUC by train wave (rows) and test wave (columns).
AUC = (
    (0.746304121621489, 0.6601503887166483, 0.6699595304339347, 0.6853116268291379, 0.6923654965143232, 0.6799881668117954, 0.6737332380893086, 0.6952737390364527, 0.687876276323017),
    (0.6520363590089836, 0.730906961302885, 0.671562572931267, 0.7021704171590369, 0.6834456931920749, 0.6883977669996206, 0.679499624812816, 0.7078730315407473, 0.6944209039049453),
    (0.6764752191042939, 0.6641967992972536, 0.7438128991526434, 0.7115643556966004, 0.697927301610108, 0.6886167602325626, 0.6895148107006808, 0.7148132737090144, 0.6995210465158339),
    (0.6702419607485844, 0.6771342646522629, 0.6960866539563508, 0.7637449533306303, 0.6923665844037639, 0.696701492596456, 0.6888483118761215, 0.7147382917588687, 0.7036829289978338),
    (0.6742681829398596, 0.6669787898348563, 0.6850960625836271, 0.6940497893635276, 0.7479874638741586, 0.6870651092823906, 0.6888069202283964, 0.7169472753873213, 0.707667695076899),
    (0.6582174517377015, 0.661957553143832, 0.6703578278965673, 0.6942495635225081, 0.6753283566808913, 0.7566302879095428, 0.6865813284211301, 0.7021057919163014, 0.6861878150642297),
    (0.6709674584640939, 0.6619015409049801, 0.6796358413562946, 0.6986400868123801, 0.6916482608959842, 0.7019957793806324, 0.7412191681148055, 0.708672662049614, 0.6926878624683034),
    (0.6656448035240985, 0.6795840599825947, 0.6881819886485947, 0.7098767608532185, 0.6975338218893166, 0.6963850452078312, 0.6890994834031098, 0.7641074255562503, 0.7116656877853511),
    (0.6638926216036481, 0.6639673030628036, 0.6822251362074219, 0.7063422811611689, 0.6969170676956807, 0.6915645317395925, 0.6806941572742442, 0.7203519794795491, 0.7543325516817566),
)

# Pooled three-wave training, test waves 2018 .. 2023 (AUC, training rows, positives).
ROLLING = {
    2018: (0.721252247319108, 61650, 2802),
    2019: (0.7075651515228237, 62105, 3043),
    2020: (0.7034393268010568, 62229, 3493),
    2021: (0.7029615439507848, 54011, 3121),
    2022: (0.7307430022948576, 53404, 3141),
    2023: (0.7200403659287177, 53944, 3213),
}

# Derived statistics.
SAME = (0.7498939813937957, 0.010886981509173124, 0.730906961302885, 0.7641074255562503)
CROSS = (0.6876727308762673, 0.015915402070595743, 0.6520363590089836, 0.7203519794795491)
GAP = 0.06222125051752836
DECAY = {
    "slope": -0.0011548493915864856, "intercept": 0.6915222288482223,
    "r_squared": 0.020764197595686165, "p_value": 0.22719107917844908, "se": 0.0009478997203552123,
}
MEAN_AT_DISTANCE = (
    0.6889233681160665, 0.6894315635466636, 0.6870562084585622, 0.6915339467039278,
    0.6865784070979881, 0.6856506618, 0.6798266873820751, 0.6758844489633326,
)
ERA = {
    "mean_first": 0.695199333194054, "sd_first": 0.012376973554927883,
    "mean_second": 0.6808534893021889, "sd_second": 0.016174198470156585,
    "difference": 0.014345843891865107, "t": 3.150103159936264, "p_value": 0.0031760258756064162,
}
TREND = {
    "slope": 0.28725968845734295, "r_squared": 0.7869094299840496, "p_value": 0.0014242250006795585,
    "relative_change_pct": 52.784897569998876, "total_n": 176957,
}
PAIRED = {
    "mean_old": 0.6996526212731418, "mean_new": 0.7143336063028914, "t": 7.182842181861938,
    "p_value": 0.0008139781398197886,
}
# High-specificity point.
HIGH_SPEC = {
    "tp": 105, "fp": 254, "fn": 101, "tn": 3278, "sens": 0.5097087378640777,
    "spec": 0.9280860702151755, "ppv": 0.2924791086350975, "npv": 0.9701094998520272,
}

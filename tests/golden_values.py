"""Published results for synthetic families."""

# (family, seed): threshold, retained edges, clusters, noise points, largest cluster of the selected row
SELECTED = {
    ("spiral", 42): (1.003237838706473, 1787, 17, 87, 325),
    ("spiral", 43): (1.0467979991621512, 1966, 10, 13, 556),
    ("spiral", 44): (1.0067347277479886, 1787, 16, 54, 353),
    ("spiral", 45): (1.0499118992801666, 1967, 13, 33, 429),
    ("spiral", 46): (1.0704937297481976, 2054, 5, 1, 710),
    ("varying_density", 42): (1.145791999104423, 3694, 2, 1, 1399),
    ("varying_density", 43): (1.0319027020292317, 2986, 2, 18, 1382),
    ("varying_density", 44): (1.1718045708032203, 3835, 2, 4, 1396),
    ("varying_density", 45): (1.0702249705318467, 3269, 2, 6, 1394),
    ("varying_density", 46): (1.068725194021362, 3269, 2, 10, 1390),
    ("touching", 42): (0.9947602075250477, 2043, 12, 77, 623),
    ("touching", 43): (0.9737884218079877, 1937, 15, 132, 585),
    ("touching", 44): (0.9767354091797337, 1937, 16, 98, 462),
    ("touching", 45): (0.9548906223230327, 1830, 27, 221, 216),
    ("touching", 46): (0.9964892979224726, 2043, 8, 47, 657),
    ("chain_noise", 42): (0.993242652293614, 1532, 4, 30, 442),
    ("chain_noise", 43): (1.0479662020235303, 1773, 5, 17, 482),
    ("chain_noise", 44): (1.0578541562006436, 1774, 6, 19, 452),
    ("chain_noise", 45): (1.0659102113717962, 1854, 2, 10, 571),
    ("chain_noise", 46): (1.1286210673023744, 2015, 3, 1, 556),
}

# (family, mode) at seed 42: adjusted Rand index
ARI = {
    ("chain_noise", "raw_length"): 0.7363278061079748,
    ("chain_noise", "local_scale"): 0.5860874781695504,
    ("chain_noise", "knn_median"): 0.3379184140685983,
    ("chain_noise", "supported_merge"): 0.8122639639994379,
    ("chain_noise", "saddle_cut"): 0.5860874781695504,
    ("chain_noise", "manifold_filter"): 0.5860874781695504,
    ("spiral", "raw_length"): 0.06386931379261859,
    ("spiral", "local_scale"): 0.04552800501640248,
    ("spiral", "knn_median"): 0.2826248658572686,
    ("spiral", "supported_merge"): 0.0263601011609875,
    ("spiral", "saddle_cut"): 0.04756855280648617,
    ("spiral", "manifold_filter"): 0.10509477592039167,
    ("touching", "raw_length"): -0.011501394505702367,
    ("touching", "local_scale"): 0.07212741458567573,
    ("touching", "knn_median"): 0.2794816731818184,
    ("touching", "supported_merge"): -0.005284237229726964,
    ("touching", "saddle_cut"): 0.34975507914517673,
    ("touching", "manifold_filter"): 0.07212741458567573,
    ("varying_density", "raw_length"): 0.6347317833740923,
    ("varying_density", "local_scale"): 0.5294516193623655,
    ("varying_density", "knn_median"): 0.5300572940258785,
    ("varying_density", "supported_merge"): 0.5294516193623655,
    ("varying_density", "saddle_cut"): 0.5294516193623655,
    ("varying_density", "manifold_filter"): 0.5294516193623655,
}

"""Named, ordered feature sets of region tables.

Two sets name the cerebellar white-matter volumes twice. The repeats are kept:
they are separate slots of the feature array and count double in a penalised fit.
"""

from __future__ import annotations

# Cortical region names, in table order.
REGIONS = (
    "bankssts caudalanteriorcingulate caudalmiddlefrontal cuneus entorhinal fusiform inferiorparietal "
    "inferiortemporal isthmuscingulate lateraloccipital lateralorbitofrontal lingual medialorbitofrontal "
    "middletemporal parahippocampal paracentral parsopercularis parsorbitalis parstriangularis pericalcarine "
    "postcentral posteriorcingulate precentral precuneus rostralanteriorcingulate rostralmiddlefrontal "
    "superiorfrontal superiorparietal superiortemporal supramarginal frontalpole temporalpole "
    "transversetemporal insula"
).split()

# Subcortical volume names, in table order.
SUBCORTICAL = (
    "Left-Lateral-Ventricle Left-Inf-Lat-Vent Left-Cerebellum-White-Matter Left-Cerebellum-Cortex "
    "Left-Thalamus-Proper Left-Caudate Left-Putamen Left-Pallidum 3rd-Ventricle 4th-Ventricle Brain-Stem "
    "Left-Hippocampus Left-Amygdala CSF Left-Accumbens-area Left-VentralDC Right-Lateral-Ventricle "
    "Right-Inf-Lat-Vent Right-Cerebellum-White-Matter Right-Cerebellum-Cortex Right-Thalamus-Proper "
    "Right-Caudate Right-Putamen Right-Pallidum Right-Hippocampus Right-Amygdala Right-Accumbens-area "
    "Right-VentralDC CC_Posterior CC_Mid_Posterior CC_Central CC_Mid_Anterior CC_Anterior"
).split()

# Summary volumes closing the thickness sets, repeats included.
SUMMARY_VOLUMES = (
    "SubCortGrayVol TotalGrayVol SupraTentorialVol Left-Cerebellum-White-Matter "
    "Right-Cerebellum-White-Matter lhCortexVol rhCortexVol"
).split()


def cortical(measure: str, mean: str | None = None) -> list[str]:
    """``lh_*`` then ``rh_*`` columns of one measure, each side optionally closed by its mean."""
    names = REGIONS + ([mean] if mean else [])
    return [f"{side}_{name}_{measure}" for side in ("lh", "rh") for name in names]


def feature_set(name: str) -> list[str]:
    intracranial = ["EstimatedTotalIntraCranialVol"]
    thickness = cortical("thickness", mean="MeanThickness") + SUBCORTICAL + SUMMARY_VOLUMES
    sets = {
        "volume": intracranial + SUBCORTICAL + cortical("volume"),
        "curvature": intracranial + SUBCORTICAL + cortical("meancurv"),
        "thickness_volume": thickness,
        "thickness_volume_curvature": thickness + cortical("meancurv"),
    }
    return sets[name]

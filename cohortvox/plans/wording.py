"""How findings are worded in the texts of a case."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BORDER = {
    "No tumor": "No tumor detected",
    "Too small to assess": "Tumor too small for border analysis",
    "Smooth contour": "Smooth, regular outer contour (note: does not indicate margin sharpness)",
    "Mildly lobulated": "Some contour irregularity with mild lobulation",
    "Lobulated": "Lobulated/irregular outer contour",
    "Highly irregular": "Highly irregular/spiculated outer contour",
}
MARGIN = {
    "No tumor": "No tumor detected",
    "Could not assess": "Insufficient peritumoral tissue for analysis",
    "Sharp transition": "Abrupt tumor-brain intensity transition, well-demarcated margin",
    "Moderate transition": "Moderately distinct margin with some gradual transition zones",
    "Gradual transition": "Indistinct margin with gradual intensity blending into brain",
    "Infiltrative transition": "No clear intensity demarcation, tumor infiltrates surrounding parenchyma",
}
CYSTIC = {
    "No tumor": "No tumor detected",
    "Predominantly cystic": "Large cystic component with thin wall/rim",
    "Cystic with solid component": "Mixed cystic and solid tumor with significant cystic component",
    "Solid with cystic component": "Predominantly solid tumor with cystic/necrotic areas",
    "Solid with necrosis": "Solid tumor with central necrotic (non-cystic) component",
    "Solid with possible cyst": "Solid tumor with possible small cystic component",
    "Solid": "Homogeneous solid tumor without significant cystic component",
}
NECROSIS = {
    "No tumor": "No tumor detected",
    "No necrosis": "No central necrosis identified, solid tumor",
    "Extensive necrosis": "Large central necrotic component (%.0f%% of tumor), characteristic of high-grade glioma",
    "Moderate necrosis": "Moderate central necrosis (%.0f%% of tumor), suggests high-grade pathology",
    "Focal necrosis": "Focal areas of necrosis (%.0f%% of tumor)",
    "Minimal necrosis": "Small necrotic foci (%.0f%% of tumor)",
}
ENHANCEMENT = {
    "Non-enhancing": "Non-enhancing pattern can be seen with lower-grade glioma, treatment effect, or other pathology; clinical and histopathological correlation required",
    "Ring-enhancing": "Peripheral rim enhancement surrounding central non-enhancing core, characteristic of high-grade glioma or metastasis",
    "Solid/nodular enhancing": "Solid pattern of enhancement without central necrosis",
}
MISMATCH = "Possible T2/FLAIR mismatch in %s: T2 hyperintense (ratio %.2f) with relatively suppressed FLAIR (ratio %.2f). May suggest IDH-mutant lower-grade glioma."
NO_MISMATCH = "No T2/FLAIR mismatch detected. Signal intensity patterns concordant between T2 and FLAIR sequences."
SEGMENTATION = {
    "Excellent": "High confidence in segmentation quality",
    "Good": "Acceptable quality, routine review recommended",
    "Fair": "Some concerns identified, careful review advised",
    "Poor": "Multiple issues detected, manual verification required",
    "Unacceptable": "Significant problems, re-segmentation may be needed",
}
GREY_WHITE = {
    "Preserved": "Normal gray-white matter differentiation",
    "Mildly reduced": "Slightly reduced gray-white differentiation",
    "Reduced": "Loss of gray-white differentiation (may indicate edema or diffuse pathology)",
    "Could not assess": "Insufficient tissue for gray-white analysis",
}
REGIONS = {"ncr": "Necrotic Core (NCR)", "ed": "Peritumoral Edema (ED)", "et": "Enhancing Tumor (ET)", "wt": "Whole Tumor (WT)", "tc": "Tumor Core (TC)"}
LIMITATIONS = (
    "Automated analysis should be verified by qualified radiologist",
    "Segmentation based on a {model} model trained on glioma cases",
    "DWI/ADC sequences not available - diffusion characteristics not assessed",
    "Perfusion imaging not available - cannot assess tumor vascularity",
)


def described(table: dict[str, str], key: Column) -> Column:
    """The wording of a class; null for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]

"""A ranker as a C header: flat arrays of nodes, and a function that walks them."""

from __future__ import annotations

from tracegrain.operators.learn import Model

#: A header larger than this is refused.
MOST_BYTES = 4 * 2**20


def nodes_of(tree) -> list[tuple[int, float, int, int, float]]:
    """(feature, threshold, left, right, value) of a tree in preorder; leaves have feature -1."""
    out: list[tuple[int, float, int, int, float]] = []

    def add(node) -> int:
        at = len(out)
        out.append((-1, 0.0, 0, 0, float(node.prediction())))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            out[at] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)
        return at

    add(tree._java_obj.rootNode())
    return out


def flat(model: Model) -> tuple[list[tuple], list[tuple[int, int, float]]]:
    """All nodes, places being absolute, and (class, root, weight) of each tree."""
    nodes: list[tuple] = []
    trees: list[tuple[int, int, float]] = []
    for k, stage in enumerate(model.stages.stages[1:]):
        for tree, weight in zip(stage.trees, stage.treeWeights, strict=True):
            base = len(nodes)
            trees.append((k, base, float(weight)))
            nodes += [(f, t, base + left if f >= 0 else 0, base + right if f >= 0 else 0, v) for f, t, left, right, v in nodes_of(tree)]
    return nodes, trees


def margins(nodes: list[tuple], trees: list[tuple], n_classes: int, vector: list[float]) -> list[float]:
    """What the header computes: the weighted sum of the trees of each class."""
    out = [0.0] * n_classes
    for k, at, weight in trees:
        while nodes[at][0] >= 0:
            f, threshold, left, right, _ = nodes[at]
            at = left if vector[f] <= threshold else right
        out[k] += weight * nodes[at][4]
    return out


def header(model: Model, name: str = "ranker") -> str:
    nodes, trees = flat(model)

    def array(kind: str, what: str, values) -> str:
        return f"static const {kind} {name}_{what}[] = {{{', '.join(map(repr, values))}}};\n"

    labels = ", ".join('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in model.labels)
    text = (
        f"/* {len(trees)} trees, {len(nodes)} nodes, {len(model.columns)} features */\n#ifndef {name.upper()}_H\n#define {name.upper()}_H\n"
        f"#define {name.upper()}_CLASSES {len(model.labels)}\n#define {name.upper()}_FEATURES {len(model.columns)}\n"
        f"static const char *const {name}_labels[] = {{{labels}}};\n"
        + array("short", "feature", [n[0] for n in nodes]) + array("double", "threshold", [n[1] for n in nodes])
        + array("int", "left", [n[2] for n in nodes]) + array("int", "right", [n[3] for n in nodes]) + array("double", "value", [n[4] for n in nodes])
        + array("int", "class", [t[0] for t in trees]) + array("int", "root", [t[1] for t in trees]) + array("double", "weight", [t[2] for t in trees])
        + f"static void {name}_margins(const double *x, double *out) {{\n  for (int k = 0; k < {len(model.labels)}; k++) out[k] = 0;\n"
        f"  for (int t = 0; t < {len(trees)}; t++) {{\n    int at = {name}_root[t];\n"
        f"    while ({name}_feature[at] >= 0) at = x[{name}_feature[at]] <= {name}_threshold[at] ? {name}_left[at] : {name}_right[at];\n"
        f"    out[{name}_class[t]] += {name}_weight[t] * {name}_value[at];\n  }}\n}}\n#endif\n"
    )
    if len(text.encode()) > MOST_BYTES:
        raise ValueError(f"the header takes {len(text.encode())} bytes, more than {MOST_BYTES}")
    return text

"""Plot-level operators: two-level medians, design checks, leave-one-block-out classification and its metrics."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..plans.chain import Step
from ..sources.adapters import CLASSES, RATES
from .curves import r6


def _rate(plot: str) -> str:
    return "case " + " ".join(f"when {plot} % 7 = {i} then {rate}" for i, rate in enumerate(RATES)) + " end"


def _class(rate: str) -> str:
    return f"case {rate} " + " ".join(f"when {k} then '{v}'" for k, v in CLASSES.items()) + " end"


def line_features(source: str = "lines") -> Step:
    """A few features of every line, from which leaves and plots are made."""

    def text(d: Spark) -> str:
        return f"select line, leaf, sample_id, plot, avg(value) f_mean, stddev_pop(value) f_std, max(value) - min(value) f_range, {d.pct('value', 0.5)} f_median, avg(value * position_fraction) f_moment from {source} group by line, leaf, sample_id, plot"

    return ("line_features", text)


FEATURES = ("f_mean", "f_std", "f_range", "f_median", "f_moment")


def plot_medians(source: str = "line_features") -> tuple[Step, ...]:
    """Median over a leaf's lines, then over a plot's leaves: a median of medians, no single grouping gives it."""

    def leaves(d: Spark) -> str:
        return f"select plot, leaf, {', '.join(f'{d.pct(f, 0.5)} {f}' for f in FEATURES)} from {source} group by plot, leaf"

    def text(d: Spark) -> str:
        rate = _rate("plot")
        return f"select plot, cast({d.idiv('plot', '7')} + 1 as int) block, {rate} n_rate, {_class(rate)} treatment, cast(count(*) as bigint) n_leaves, {', '.join(f'{r6(d.pct(f, 0.5))} {f}' for f in FEATURES)} from leaves group by plot"

    return (("leaves", leaves), ("plots", text))


def design_check(source: str = "plots") -> Step:
    """Plots of each treatment, blocks it stands in and whether it is balanced over them."""

    def text(d: Spark) -> str:
        return f"""
        select treatment, cast(sum(n) as bigint) n_plots, cast(count(*) as bigint) n_blocks, max(n) = min(n) and count(*) = 3 balanced
        from (select treatment, block, count(*) n from {source} group by treatment, block) t group by treatment"""

    return ("design", text)


def block_pivot(source: str = "plots") -> Step:
    """Crosstab of treatment by block."""

    def text(d: Spark) -> str:
        return f"select treatment, {', '.join(f'cast(sum(case when block = {b} then 1 else 0 end) as bigint) block_{b}' for b in (1, 2, 3))} from {source} group by treatment"

    return ("crosstab", text)


def by_feature(features: tuple[str, ...] = FEATURES, name: str = "feature", value: str = "v") -> tuple[str, str]:
    """Suffix of a FROM clause that gives each row once for every feature, and the feature's value: the source is read once."""
    return f"cross join (values {', '.join(f"('{f}')" for f in features)}) k_{name}({name})", f"case {name} {' '.join(f"when '{f}' then {f}" for f in features)} end {value}"


def anova(source: str = "plots") -> Step:
    """F of each feature between treatments; 0 where it is undefined."""

    def text(d: Spark) -> str:
        each, value = by_feature()
        return f"""
        select feature, {r6("coalesce(case when ssw > 1e-12 and n > k then (ssb / (k - 1)) / (ssw / (n - k)) end, cast(0 as double))")} anova_f
        from (select feature, count(*) k, sum(n) n, sum(n * power(m - grand, 2)) ssb, sum(n * s) ssw
          from (select feature, n, m, s, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) grand
            from (select feature, treatment, count(*) n, avg(v) m, var_pop(v) s from (select feature, treatment, {value} from {source} {each}) e group by feature, treatment) t) g group by feature) h"""

    return ("anova", text)


def pearson(source: str = "plots") -> Step:
    """Correlation of every pair of features over the plots."""

    def text(d: Spark) -> str:
        (one, first), (two, second) = by_feature(name="feature_1", value="a"), by_feature(name="feature_2", value="b")
        order = f"case feature_2 {' '.join(f"when '{f}' then {i}" for i, f in enumerate(FEATURES))} end > case feature_1 {' '.join(f"when '{f}' then {i}" for i, f in enumerate(FEATURES))} end"
        return f"select feature_1, feature_2, {r6(d.corr('a', 'b'))} r from (select feature_1, feature_2, {first}, {second} from {source} {one} {two} where {order}) e group by feature_1, feature_2"

    return ("pearson", text)


def nearest_centroid(source: str = "plots") -> tuple[Step, ...]:
    """Leave one block out: standardise by the training plots alone, then take the nearest class mean (ties: by name)."""

    def folds(d: Spark) -> str:
        return f"select f.fold, p.*, case when p.block = f.fold then 'test' else 'train' end role from {source} p cross join (select distinct block fold from {source}) f"

    def scaled(d: Spark) -> str:
        z = ", ".join(f"case when s.sd_{f} > 1e-6 then (p.{f} - s.m_{f}) / s.sd_{f} else cast(0 as double) end z_{f}" for f in FEATURES)
        stats = ", ".join(f"avg({f}) m_{f}, stddev_pop({f}) sd_{f}" for f in FEATURES)
        return f"select p.fold, p.plot, p.block, p.treatment, p.role, {z} from folds p join (select fold, {stats} from folds where role = 'train' group by fold) s on p.fold = s.fold"

    def centroids(d: Spark) -> str:
        return f"select fold, treatment, {', '.join(f'avg(z_{f}) c_{f}' for f in FEATURES)} from scaled where role = 'train' group by fold, treatment"

    def text(d: Spark) -> str:
        dist = " + ".join(f"power(t.z_{f} - c.c_{f}, 2)" for f in FEATURES)
        return f"""
        select plot, block, true_treatment, predicted_treatment, true_treatment = predicted_treatment correct from (
          select t.plot, t.block, t.treatment true_treatment, c.treatment predicted_treatment, row_number() over (partition by t.plot order by round({dist}, 9), c.treatment) rk
          from scaled t join centroids c on t.fold = c.fold where t.role = 'test') r where rk = 1"""

    return (("folds", folds), ("scaled", scaled), ("centroids", centroids), ("predictions", text))


def confusion(source: str = "predictions") -> Step:
    """Counts of true by predicted class, in a fixed order of classes, with zeros."""

    def text(d: Spark) -> str:
        classes = sorted(set(CLASSES.values()))
        rows = " union all ".join(f"select '{c}' true_treatment" for c in classes)
        cols = ", ".join(f"cast(coalesce(sum(case when p.predicted_treatment = '{c}' then 1 else 0 end), 0) as bigint) pred_{c.lower()}" for c in classes)
        return f"select k.true_treatment, {cols} from ({rows}) k left join {source} p on k.true_treatment = p.true_treatment group by k.true_treatment"

    return ("confusion", text)


def metrics(source: str = "predictions") -> Step:
    """Accuracy, balanced accuracy (mean recall over true classes) and macro F1 (0 where undefined)."""

    def text(d: Spark) -> str:
        one = "cast(1 as double)"
        per = f"""
        select c, sum(case when true_treatment = c then 1 else 0 end) support, sum(case when predicted_treatment = c then 1 else 0 end) named, sum(case when true_treatment = c and predicted_treatment = c then 1 else 0 end) hit
        from (select distinct true_treatment c from {source} union select distinct predicted_treatment from {source}) k cross join {source} group by c"""
        return f"""
        select {r6(f"(select avg(case when correct then {one} else 0 * {one} end) from {source})")} accuracy, {r6("avg(case when support > 0 then hit / cast(support as double) end)")} balanced_accuracy,
          {r6("avg(case when support + named > 0 then 2 * hit / cast(support + named as double) else cast(0 as double) end)")} macro_f1 from ({per}) t"""

    return ("metrics", text)


def pair_medians(source: str = "line_features") -> tuple[Step, ...]:
    """All pairs of the five line positions, each pair's median per leaf and plot, and pairs in order of their spread."""

    def pairs(d: Spark) -> str:
        p = f"(select distinct sample_id from {source})"
        return f"select concat('line_', cast(a.sample_id + 1 as string), '+line_', cast(b.sample_id + 1 as string)) pair_id, a.sample_id s1, b.sample_id s2 from {p} a join {p} b on a.sample_id < b.sample_id"

    def leaf(d: Spark) -> str:
        # A line stands in the pairs of its position: an equality join after both positions of a pair are listed.
        return f"select p.pair_id, f.plot, f.leaf, {d.pct('f.f_mean', 0.5)} m from {source} f join (select pair_id, s1 s from pairs union all select pair_id, s2 from pairs) p on f.sample_id = p.s group by p.pair_id, f.plot, f.leaf"

    def plot(d: Spark) -> str:
        return f"select pair_id, plot, {d.pct('m', 0.5)} m from pair_leaf group by pair_id, plot"

    def text(d: Spark) -> str:
        return f"select pair_id, n_plots, {r6('spread')} spread, cast(row_number() over (order by round(spread, 6) desc, pair_id) as bigint) position from (select pair_id, cast(count(*) as bigint) n_plots, stddev_samp(m) spread from pair_plot group by pair_id) t"

    return (("pairs", pairs), ("pair_leaf", leaf), ("pair_plot", plot), ("pair_ranks", text))


def best_position(source: str = "line_features") -> Step:
    """Top row of each plot: the leaf and line of greatest range (ties: by line)."""

    def text(d: Spark) -> str:
        return f"select plot, leaf, sample_id, {r6('f_range')} f_range from (select *, row_number() over (partition by plot order by round(f_range, 9) desc, line) rk from {source}) t where rk = 1"

    return ("best", text)


def attach_labels() -> Step:
    """Left join of documents to their labels, many to one; conflicting labels are flagged, not multiplied."""

    def text(d: Spark) -> str:
        return """
        select o.doc_id, o.lang, l.quality, coalesce(l.conflict, false) conflict from @documents o
        left join (select doc_id, max(quality) quality, count(distinct quality) > 1 conflict from @labels group by doc_id) l on o.doc_id = l.doc_id"""

    return ("labelled", text)


def parse_names() -> Step:
    """File names of leaf images by their pattern: six parts; names that don't fit give no row."""

    def text(d: Spark) -> str:
        pattern = "^([A-Za-z]+)_([0-9]+)_([A-Za-z]+)_([0-9]+)_(Leaf[0-9]+)_([0-9]+)(_green_profiles|_leaf_mask|_leaf_crop)?$"
        # Names made of each page's host, language and number, so that some fit the pattern and some don't.
        name = f"concat({d.rx('url', '//([a-z]+)[.]', 1)}, '_', cast(page_id as string), '_', {d.rx('url', '/(en|de|fr|es)/', 1)}, '_', cast(page_id % 7 as string), '_Leaf', cast(page_id % 3 + 1 as string), '_', cast(1000000 + page_id as string), case when page_id % 2 = 0 then '_green_profiles' else '' end)"
        names = ("prefix", "plot_number", "geno", "plant_number", "leaf", "timestamp_text", "suffix")
        cols = ", ".join(f"{d.rx('name', pattern, i + 1)} {n}" for i, n in enumerate(names))
        return f"select page_id, {cols} from (select page_id, {name} name from @pages) t where {d.rlike('name', pattern)}"

    return ("parsed", text)

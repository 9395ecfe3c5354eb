"""Word lists of the tokenisers."""

from __future__ import annotations

# The lists decide which tokens count.
LOGICAL = """step steps step1 step2 step3 step4 step5 first second third next then finally
if else elif when whenever unless provided because since as due therefore thus hence so consequently accordingly
and or but however moreover furthermore additionally also besides
implies imply conclude conclusion infer inference deduce deduction
prove proof proven disprove disproven contradiction contradictory assume assumption
fact facts given premise premises hypothesis statement claim
all any some none every each not no never always
equal equals equivalent same different greater less than from""".split()
COMMON_LOGICAL = """because also so and or but if then therefore thus since as when not no all any some each every fact facts
step steps prove proof conclude conclusion approve disprove given statement claim implies however""".split()
STOP = """the a an is are was were be been being have has had do does did will would could should may might must can this that these those
it its they them their there here where what which who whom whose how why when to of in on at by for with from as into onto up
down out off over under above below between among through during before after while about
against within without throughout across around near far inside outside beside besides except
including excluding concerning regarding according i you he she we us our your my me him her his hers mine yours ours theirs""".split()
MATH_OPERATIONS = """simplify simplifies simplified substitute substituting substitution expand expanding factor factoring factorize
solve solving cancel cancels eliminate eliminating multiply multiplying divide dividing subtract subtracting
add adding rearrange rearranging isolate isolating equation equations inequality expression formula
polynomial quadratic linear coefficient variable numerator denominator fraction exponent root radical
midpoint distance radius diameter area perimeter angle sine cosine tangent hypotenuse perpendicular
parallel congruent similar vertex vertices remainder divisible prime modulo factorial permutation combination probability
derivative integral maximum minimum critical verify verifying check checking confirm plug validate
therefore thus hence conclude obtain get find""".split()
MATH_COMMON = """step steps let so now also then first second third next finally note notice use
using since because have need want know see can we this that which problem question
answer solution result value number equal equals side left right both each all any""".split()
LATEX = """frac sqrt cdot times div pm mp leq geq neq approx sum prod int lim infty partial nabla Delta Sigma Pi
alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega left right text mathrm mathbf overline hat vec bar""".split()
OVERLAP_STOP = """the a an is are was were be been have has had this that and or but so then if we it its from to of in on at by for with can not no""".split()
ALIGN_STOP = """the and for that this with from are was were have has had then therefore thus hence since because step fact facts given which into its""".split()
CALLS = """sqrt cbrt root exp log ln Abs abs sign sin cos tan cot sec csc asin acos atan acot asec acsc
sinh cosh tanh coth asinh acosh atanh floor ceiling gcd lcm Min Max""".split()

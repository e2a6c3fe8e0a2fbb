"""The rule base, as data. Names, paths, expressions, function lists, phases and technique ids are fixed values."""

from __future__ import annotations

VERSIONS = [("0.1.0", 1), ("0.2.0", 2), ("0.3.0", 3), ("0.4.0", 4)]

HOOKS = ["onLoad_base", "onAttach_base", "onDetach_base", "onUnload_base", "LastLib_base", "on_load_rlang"]
RD = ["Rd_examples", "Rd_Sexpr_build", "Rd_Sexpr_install", "Rd_Sexpr_render"]
R_CODE, RD_PAGE = r"\.[RrSsq]$", r"\.[Rr]d$"

# name, type, report, path, recursive, filename, code contexts (None / "computed" / names), assume_called, phases
FILE_RULES = [
    ("R_scripts", "R", False, "R", False, R_CODE, HOOKS, False, "build check install_src"),
    ("R_scripts_unix", "R", False, "R/unix", False, R_CODE, HOOKS, False, "build check install_src"),
    ("R_scripts_windows", "R", False, "R/windows", False, R_CODE, HOOKS, False, "build check install_src"),
    ("cleanup", "shell", True, ".", False, r"^cleanup$", None, None, "build"),
    ("cleanup_ucrt", "shell", True, ".", False, r"^cleanup\.ucrt$", None, None, "build"),
    ("cleanup_win", "shell", True, ".", False, r"^cleanup\.win$", None, None, "build"),
    ("configure", "shell", True, ".", False, r"^configure$", None, None, "build check install_src"),
    ("configure_ac", "shell", True, ".", False, r"^configure\.ac$", None, None, "autoconf"),
    ("configure_in", "shell", True, ".", False, r"^configure\.in$", None, None, "autoconf"),
    ("configure_ucrt", "shell", True, ".", False, r"^configure\.ucrt$", None, None, "build check install_src"),
    ("configure_win", "shell", True, ".", False, r"^configure\.win$", None, None, "build check install_src"),
    ("data_scripts", "R", False, "data", False, R_CODE, "computed", True, "build install_src"),
    ("data_serialized", "other", False, "data", False, r"\.(rda|RData|rdata|rds)$", None, None, "check install_src load"),
    ("demo_scripts", "R", False, "demo", False, R_CODE, "computed", True, ""),
    ("description", "other", False, ".", False, r"^DESCRIPTION$", None, None, ""),
    ("exec_other", "other", False, "exec", False, r"\.(py|pl|rb|bat|ps1|tcl|lua)$", None, None, ""),
    ("exec_scripts_R", "R", False, "exec", False, R_CODE, "computed", True, ""),
    ("exec_scripts_shell", "shell", False, "exec", False, r"\.(sh|bash|ksh|zsh|csh)$", None, None, ""),
    ("inst_citation", "R", False, "inst", False, r"^CITATION$", "computed", True, "check"),
    ("inst_tests", "R", False, "inst/tests", False, R_CODE, "computed", True, "check"),
    ("inst_tinytest", "R", False, "inst/tinytest", False, R_CODE, "computed", True, "check"),
    ("inst_unittests", "R", False, "inst/unitTests", False, R_CODE, "computed", True, "check"),
    ("inst_web", "other", False, "inst", True, r"\.(js|mjs|ts)$", None, None, ""),
    ("man_pages", "Rd", False, "man", False, RD_PAGE, RD, True, "build check install_src"),
    ("man_pages_unix", "Rd", False, "man/unix", False, RD_PAGE, RD, True, "build check install_src"),
    ("man_pages_windows", "Rd", False, "man/windows", False, RD_PAGE, RD, True, "build check install_src"),
    ("r_sysdata", "other", False, "R", False, r"^sysdata\.rda$", None, None, "check install_src load"),
    ("rprofile", "R", False, ".", False, r"^\.Rprofile$", "computed", True, "build install_src"),
    ("src_compiled", "other", False, "src", True, r"\.(c|cc|cpp|cxx|C|h|hpp|hxx|ipp|f|f90|f95|f03|f77|for|m|mm|rs|java)$", None, None, "check install_src load"),
    ("src_install_libs_R", "R", True, "src", False, r"^install\.libs\.R$", "computed", True, "build check install_src"),
    ("src_makefile", "make", True, "src", False, r"^Makefile$", None, None, "build check install_src"),
    ("src_makefile_ucrt", "make", True, "src", False, r"^Makefile\.ucrt$", None, None, "build check install_src"),
    ("src_makefile_win", "make", True, "src", False, r"^Makefile\.win$", None, None, "build check install_src"),
    ("src_makevars", "make", True, "src", False, r"^Makevars$", None, None, "build check install_src"),
    ("src_makevars_in", "make", True, "src", False, r"^Makevars\.in$", None, None, "build check install_src"),
    ("src_makevars_ucrt", "make", True, "src", False, r"^Makevars\.ucrt$", None, None, "build check install_src"),
    ("src_makevars_win", "make", True, "src", False, r"^Makevars\.win$", None, None, "build check install_src"),
    ("src_other", "other", False, "src", True, r".", None, None, "check install_src load"),
    ("tests_scripts", "R", False, "tests", False, R_CODE, "computed", True, "check"),
    ("tests_testthat", "R", False, "tests/testthat", False, R_CODE, "computed", True, "check"),
    ("tools_scripts", "R", False, "tools", False, R_CODE, "computed", True, ""),
    ("vignettes_qmd", "qmd", False, "vignettes", False, r"\.qmd$", "computed", True, "build check"),
    ("vignettes_rmd", "Rmd", False, "vignettes", False, r"\.[Rr]md$", "computed", True, "build check"),
    ("vignettes_rnw", "Rnw", False, "vignettes", False, r"\.[Rr]nw$", "computed", True, "build check"),
    ("vignettes_rsp", "rsp", False, "vignettes", False, r"\.rsp$", "computed", True, "build check"),
]

# name, kind, what it matches (an assigned hook, a call, or a segment label), phases
CODE_RULES = [
    ("LastLib_base", "xpath", ("assign", ".Last.lib"), "check detach"),
    ("Rd_Sexpr_build", "segment", ("label", "Rd_Sexpr_build"), "build check install_src"),
    ("Rd_Sexpr_install", "segment", ("label", "Rd_Sexpr_install"), "build check install_src"),
    ("Rd_Sexpr_render", "segment", ("label", "Rd_Sexpr_render"), "build check"),
    ("Rd_examples", "segment", ("label", "Rd_examples"), "check"),
    ("onAttach_base", "xpath", ("assign", ".onAttach"), "build check install_src attach"),
    ("onDetach_base", "xpath", ("assign", ".onDetach"), "check detach"),
    ("onLoad_base", "xpath", ("assign", ".onLoad"), "build check install_src load"),
    ("onUnload_base", "xpath", ("assign", ".onUnload"), "check unload"),
    ("on_load_rlang", "xpath", ("call", "on_load"), "build check install_src load"),
]

# name, version, technique ids, functions called bare
PATTERN_RULES = [
    ("chmod", "0.1.0", "T1222", "Sys.chmod Sys.umask"),
    ("credentials", "0.4.0", "T1552.001", ""),
    ("curl", "0.4.0", "T1041", "curl curl_fetch_memory curl_fetch_disk curl_fetch_stream curl_fetch_multi curl_download curl_upload multi_download multi_run send_mail"),
    ("decoding", "0.4.0", "T1140", "base64decode base64_dec base64_decode memDecompress"),
    ("deserialization", "0.4.0", "T1059", "readRDS load unserialize dget"),
    ("download_file", "0.4.0", "T1105", "download.file url"),
    ("dynload", "0.4.0", "T1129", "dyn.load library.dynam"),
    ("eval_parse", "0.4.0", "T1027 T1059 T1140", ""),
    ("fs", "0.1.0", "T1222", "file_chmod file_chown"),
    ("httr", "0.4.0", "T1041", "GET POST PUT PATCH DELETE HEAD VERB"),
    ("httr2", "0.4.0", "T1041", "req_perform req_perform_iterative req_perform_parallel req_perform_sequential req_perform_stream req_perform_connection req_perform_promise"),
    ("install", "0.4.0", "T1105", "install.packages install_github install_gitlab install_bitbucket install_git install_url install_version install_local install_bioc install_dev install_cran pak pkg_install local_install lockfile_install py_install virtualenv_install conda_install virtualenv_create conda_create"),
    ("namespace", "0.1.0", "T1027 T1574", "getFromNamespace getExportedValue getAnywhere assignInNamespace assignInMyNamespace unlockBinding"),
    ("options_repos", "0.3.0", "T1195.002", ""),
    ("persistence", "0.1.0", "T1546.004 T1053.003", ""),
    ("python", "0.1.0", "T1059.006 T1027", "py_run_string py_run_file py_eval source_python py_call import_builtins"),
    ("rcurl", "0.4.0", "T1041", "getURL getURI getForm postForm curlPerform"),
    ("socket", "0.4.0", "T1041 T1095", "socketConnection make.socket serverSocket socketAccept"),
    ("source", "0.4.0", "T1059", "source"),
    ("system", "0.4.0", "T1059.003 T1059.004", "system system2 shell pipe"),
    ("system_callr", "0.4.0", "T1059", "r_bg r_safe r_copycat r_vanilla rscript rcmd_bg rcmd_safe rcmd_copycat"),
    ("system_processx", "0.3.0", "T1059", ""),
    ("system_sys", "0.4.0", "T1059", "exec_wait exec_background exec_internal eval_safe eval_fork r_background r_internal r_wait"),
]

# rule, function, package before ::
PACKAGE_CALLS = [("install", "install", p) for p in ("BiocManager", "renv", "devtools")] + [("system_callr", f, "callr") for f in ("r", "rcmd")] + [("system_processx", f, "processx") for f in ("run", "pipeline")]
# rule, class symbols below X$new()
CLASS_NEWS = [("system_callr", s) for s in ("r_session", "r_process", "rcmd_process", "rscript_process")] + [("system_processx", "process")]
# rule, outer calls, sets of calls of which each must occur below the same call expression
CAPABILITIES = ("decoding", "curl", "rcurl", "httr", "httr2", "deserialization", "download_file", "system", "system_sys", "system_callr", "socket", "python")
READERS = ("rawToChar", "readBin", "readLines", "scan")
PARSERS = ("parse", "str2lang", "str2expression")
PERSISTENCE = (
    ".bashrc", ".bash_profile", ".bash_login", ".bash_logout", ".profile", ".zshrc", ".zprofile", ".zshenv", ".cshrc",
    ".Rprofile", ".Renviron", "crontab", "LaunchAgents", "LaunchDaemons", "/etc/cron", "/etc/systemd", "rc.local",
)
SECRET_PATHS = ("~/.ssh/", "~/.aws/", ".netrc", "id_rsa", "~/.gnupg/")
SECRET_NAMES = ("TOKEN", "SECRET", "PASSWORD", "API_KEY")
#: Functions that run what their string argument names, and the parameter that names it.
INDIRECT = {"do.call": "what", "match.fun": "FUN", "getFunction": "name"}

# name, technique ids, regular expression (Java)
_BEFORE, _AFTER = r"(?<=^|[^\p{Alnum}_-])", r"(?=[^\p{Alnum}_./-]|$)"
MATCH_RULES = [
    ("chmod", "T1222", _BEFORE + r"(chmod" + _AFTER + r"[^|;&\n]{0,40}?([+][rwXst]*[xs]|[246][0-7]{3}|777)|umask" + _AFTER + r"\s+(-S\s+)?(0+(?![0-7])|a=rwx|u=rwx,g=rwx,o=rwx))"),
    ("credentials", "T1552.001", r"\.ssh/|\.aws/|\.netrc|id_rsa|\.gnupg/|\$\{?[A-Z0-9_]*(TOKEN|SECRET|PASSWORD|API_KEY)[A-Z0-9_]*"),
    ("curl", "T1041 T1105", _BEFORE + r"curl(?=(\.exe)?([^\p{Alnum}_./-]|$))"),
    ("decoding", "T1140 T1027", _BEFORE + r"(base64[^|;&\n]{0,40}(--decode|-[dD])|openssl\s+enc[^|;&\n]{0,60}-d|xxd[^|;&\n]{0,20}-r|uudecode)"),
    ("install", "T1195.002 T1105", _BEFORE + r"(pip[23]?|npm|yarn|apt-get|apt|yum|dnf|apk|brew|conda|gem|cargo|go)\s+(install|add|get)" + _AFTER),
    ("interpreter", "T1059", _BEFORE + r"(python[23]?|perl|ruby|node|osascript|powershell|pwsh)" + _AFTER),
    ("persistence", "T1546 T1053.003", r"(\.bashrc|\.bash_profile|\.bash_login|\.bash_logout|\.profile|\.zshrc|\.zprofile|\.zshenv|\.cshrc|\.Rprofile|\.Renviron|crontab|LaunchAgents|LaunchDaemons|/etc/cron|/etc/systemd|\.config/systemd|/etc/rc\.local)"),
    ("rscript", "T1059", _BEFORE + r"Rscript(?=(\.exe)?([^\p{Alnum}_./-]|$))"),
    ("socket", "T1041 T1095", _BEFORE + r"(nc|ncat|netcat|socat|telnet)(?=\s)|/dev/(tcp|udp)/"),
    ("transfer", "T1041 T1105", _BEFORE + r"(scp|sftp|ftp|rsync|svn)" + _AFTER + "|" + _BEFORE + r"git\s+clone" + _AFTER),
    ("wget", "T1041 T1105", _BEFORE + r"wget(?=(\.exe)?([^\p{Alnum}_./-]|$))"),
]

#: Of each line rule, strings of which every match holds one.
NEEDS = {
    "chmod": "chmod umask", "credentials": ".ssh/ .aws/ .netrc id_rsa .gnupg/ TOKEN SECRET PASSWORD API_KEY", "curl": "curl", "decoding": "base64 openssl xxd uudecode", "install": "install add get",
    "interpreter": "python perl ruby node osascript powershell pwsh", "persistence": "rc .bash_ .profile .zprofile .zshenv .Rprofile .Renviron cron Launch systemd", "rscript": "Rscript",
    "socket": "nc cat telnet /dev/", "transfer": "scp ftp rsync svn git", "wget": "wget",
}

#: What each finding says; a name may be used by a pattern and a match rule alike.
SAYS = {
    "chmod": "changes file permissions", "credentials": "names a place or variable that holds credentials", "curl": "moves data over the network with curl",
    "decoding": "decodes an encoded payload", "deserialization": "restores serialized objects, which can run code", "download_file": "downloads a file",
    "dynload": "loads a compiled library", "eval_parse": "evaluates text that is read, decoded or downloaded", "fs": "changes file permissions or owners",
    "httr": "sends HTTP requests", "httr2": "sends HTTP requests", "install": "installs further software", "interpreter": "starts a script interpreter",
    "namespace": "reaches into or alters another namespace", "options_repos": "changes where packages are installed from", "persistence": "touches files that run at login or on a schedule",
    "python": "runs Python code", "rcurl": "moves data over the network", "rscript": "starts another R process", "socket": "opens a network socket", "source": "runs a script",
    "system": "runs an operating system command", "system_callr": "starts another R process", "system_processx": "starts a process", "system_sys": "runs a command or code in another process",
    "transfer": "transfers files from or to another machine", "wget": "downloads with wget",
}
